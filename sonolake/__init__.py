"""sonolake: speech-corpus curation and evaluation analytics as Spark jobs."""
