"""SentencePiece encoding with spans and decoding, against the library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from sonolake.llm import pieces

DOCS = "doc_id long, text string, ids string, `row` string"
LONG = " ".join(f"wörd{i % 977}" for i in range(30_000))
TEXTS = [
    (None, None), (0, ""), (1, " "), (2, "   "), (3, " lead and trail  "), (4, "▁literal ▁▁ marks▁"), (5, "日本語 テスト 🎉🎉 \U0010ffff ñ"), (6, "\0nul \0"), (6, "\0nul \0"), (7, "nul"),
    (8, "tabs\tand\r\nlines\n\n"), (9, "x" * 5000), (10, "<s> </s> <unk> <0x41>"), (11, LONG), (12, "ﬁ ½ ＡＢ ¨ a"), (None, "null id"),
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


def test_digest_is_the_library_s(spark, library):
    docs = spark.createDataFrame([(i, t, "ids", "row") for i, t in TEXTS], DOCS).repartition(3)
    got = sorted(map(repr, pieces.digest(docs).drop("n_bytes").collect()))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = pieces.digest(docs.limit(0)).drop("n_bytes")
    assert want.count() == 0
    rows = [(i, library.encode(t or "")) for i, t in TEXTS]
    rows = spark.createDataFrame([(i, len(x), sha(",".join(map(str, x))), sha(library.decode(x))) for i, x in rows], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    assert got == sorted(map(repr, rows.collect()))


def test_spans_cover_the_source(spark, library):
    docs = spark.createDataFrame([(i, t, "ids", "row") for i, t in TEXTS], DOCS)
    path = public_tokenizers.path(pieces.MODEL)
    text = {i: t for i, t in TEXTS if i is not None}
    for r in pieces.encode(docs.where("doc_id is not null"), path).collect():
        assert r.ids == library.encode(text[r.doc_id])
        assert r.ends == [p.end for p in library.encode(text[r.doc_id], return_type="proto").pieces]
        assert (r.ends[-1] if r.ends else 0) == len(text[r.doc_id].encode())


@pytest.mark.parametrize("trim", [True, False])
@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("suffix", [True, False])
def test_character_maps_are_followed_by_longest_prefix(library, trim, rule, suffix):
    model = proto.ModelProto.FromString(pieces.model_bytes(public_tokenizers.path(pieces.MODEL)))
    own = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    model.normalizer_spec.CopyFrom(proto.ModelProto.FromString(own).normalizer_spec)
    model.normalizer_spec.add_dummy_prefix = model.normalizer_spec.escape_whitespaces = True
    model.normalizer_spec.remove_extra_whitespaces = trim
    model.trainer_spec.treat_whitespace_as_suffix = suffix
    blob = model.SerializeToString()
    library, own, back = sentencepiece.SentencePieceProcessor(model_proto=blob), pieces.Encoder(blob), pieces.Decoder(blob)
    texts = [t or "" for _, t in TEXTS if t != LONG] + ["Å é ｶﾞ　x", "​\x01 z", "㍿ ﷺ 日本  Ⅷ", "nbsp\xa0 \xa0 end\xa0"]
    for text, (ids, ends, _) in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text)
        assert ends.tolist() == [p.end for p in library.encode(text, return_type="proto").pieces]
        assert back.decode(ids.astype(np.int64)).decode() == library.decode(ids.tolist())


def test_memory_of_words_is_bounded_and_stretches_join(library, monkeypatch):
    monkeypatch.setattr(pieces, "KNOWN_WORDS", 50)
    monkeypatch.setattr(pieces, "STRETCH", 100)
    own = pieces.Encoder(pieces.model_bytes(public_tokenizers.path(pieces.MODEL)))
    for text in [LONG[:20_000], "a  b" * 300, " " * 1000, "y" * 1000]:
        ids, ends, sha = next(own.encode([text]))
        want = library.encode(text)
        assert ids.tolist() == want and sha == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert ends.tolist() == [p.end for p in library.encode(text, return_type="proto").pieces]


def test_any_ids_decode_as_the_library_does(spark, library):
    rng = np.random.default_rng(5)
    lists = [rng.integers(0, 32_000, n).tolist() for n in (1, 5, 200)] + [rng.integers(3, 259, 50).tolist(), [0, 1, 2], [], None]
    got = pieces.decode(spark.createDataFrame([(x, "d") for x in lists], "ids array<int>, decoded_too string"), public_tokenizers.path(pieces.MODEL)).collect()
    assert [(r.decoded, r.decoded_too) for r in got] == [(None if x is None else library.decode(x), "d") for x in lists]
