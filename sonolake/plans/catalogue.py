"""Registered queries over whole tables, and SQL for those that SQL expresses in reasonable time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sonolake.functions import text as t
from sonolake.functions import tokens
from sonolake.operators import curate, errorrate, lm, packed, report, sampling, segments, signal, timing
from sonolake.plans import views
from sonolake.sources import readers, writers
from sonolake.streaming import endings as ends
from sonolake.streaming import fusion, overlaps, windows
from sonolake.tables import drained, indexed, ranked, seeded, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CHARSET = " '" + "abcdefghijklmnopqrstuvwxyz"
# views in SQL, for the oracles
MANIFEST = "select source || '/' || lang || '/' || doc_id || '.flac' as fname, text as transcript, n_chars / 15.0::double as duration, cast(floor(n_chars / 15.0::double * 16000) as bigint) as num_samples, source as manifest, doc_id as utt from documents"
WORDS = r"list_filter(string_split_regex({c}, '[ \n\t\r]+'), lambda x: x <> '')"
TURNS = "select * from (select conv_id, turn, role, text as ref, lead(text) over w as hyp, lead(role) over w as nxt from conversations window w as (partition by conv_id order by turn)) where role = 'user' and nxt = 'assistant'"
CTM = f"select file, i - 1 as seq, (i - 1) * 0.3::double as start, w[i] as word from (select doc_id as file, {WORDS.format(c='text')} as w from documents) x, unnest(range(1, len(w) + 1)) as u(i)"
LATE = "('0x' || substr(md5(file || '|' || seq), 1, 1))::int"
RESPONSES = "select user_id as session, event_id as seq, epoch_us(ts) / 1e6::double as ts, case when event_type in ('view', 'click') then 'partial' when event_type = 'purchase' then 'final' when event_type = 'signup' then 'session_start' else 'session_end' end as kind, json_extract_string(props, '$.k') as text from events"
KEYWORDS = "select phrase, max(weight) as weight from (select x[1] || ' ' || x[2] as phrase, (item_id % 5 + 1)::double as weight from (select item_id, string_split_regex(lower(text), '[^a-z]+') as x from benchmark)) group by phrase"
VALUES = "select vec_id, label, i - 1 as dim, e[i]::double as x from (select vec_id, label, embedding as e from embeddings) y, unnest(range(1, len(e) + 1)) as u(i)"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# error rates


@query()
def wer_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return errorrate.error_rate(views.pairs(spark, sf), ["source"])


def _turn_tokens(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    split = errorrate.TOKENS[kind]
    return views.turn_pairs(spark, sf).select("conv_id", "turn", split(F.col("ref")).alias("ref_words"), split(F.col("hyp")).alias("hyp_words"))


def _distance_sql(split: str) -> str:
    return f"""with recursive p as (select conv_id, turn, {split.format(c='ref')} as r, {split.format(c='hyp')} as h from ({TURNS})),
    dp(conv_id, turn, i, row_, r, h) as (select conv_id, turn, 0::bigint, range(0, len(h) + 1), r, h from p
      union all select conv_id, turn, i + 1, list_reduce(range(1, len(h) + 1), lambda acc, j: list_append(acc, least(acc[len(acc)] + 1, row_[j + 1] + 1, row_[j] + (case when r[i + 1] = h[j] then 0 else 1 end))), [i + 1]), r, h from dp where i < len(r))
    select {{cols}} from (select conv_id, turn, len(r) as n, row_[len(h) + 1] as e from dp where i = len(r)) {{rest}}"""


_SPLIT = r"list_filter(string_split_regex(trim({c}), '\s+'), lambda x: x <> '')"


@query(_distance_sql(_SPLIT).format(cols="conv_id, sum(e)::bigint as errors, sum(n)::bigint as words, round(case when sum(n) > 0 then sum(e)::double / sum(n) else 'inf'::double end, 8) as rate", rest="group by conv_id"))
def wer_by_conversation(spark: SparkSession, sf: str) -> DataFrame:
    return errorrate.error_rate(_turn_tokens(spark, sf, "wer"), ["conv_id"])


@query(_distance_sql(_SPLIT).format(cols="turn % 3 as checkpoint, round(100 * sum(e)::double / sum(n), 3) as percent", rest="group by turn % 3"))
def wer_by_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    # turns stand in for what a checkpoint has transcribed, dealt to three of them
    return errorrate.by_checkpoint(views.turn_pairs(spark, sf).withColumn("checkpoint", F.expr("turn % 3")))


@query()
def cer_by_conversation(spark: SparkSession, sf: str) -> DataFrame:
    return errorrate.error_rate(_turn_tokens(spark, sf, "cer"), ["conv_id"])


@query(_distance_sql(_SPLIT).format(cols="sum(e)::bigint as errors, sum(n)::bigint as words, round(sum(e)::double / sum(n), 8) as rate", rest=""))
def mer_total(spark: SparkSession, sf: str) -> DataFrame:
    return errorrate.error_rate(_turn_tokens(spark, sf, "mer"), [])


@query(f"""with recursive t as ({TURNS}), x as (select conv_id, turn, v, case v when 'none' then ref when 'case' then lower(ref) when 'marks' then translate(ref, '.,?-', '') else replace(ref, v[6:6], '') end as a,
        case v when 'none' then hyp when 'case' then lower(hyp) when 'marks' then translate(hyp, '.,?-', '') else replace(hyp, v[6:6], '') end as b from t, unnest(['none', 'case', 'mark .', 'mark ,', 'mark ?', 'mark -', 'marks']) as u(v)),
    p as (select conv_id, turn, v, {_SPLIT.format(c='a')} as r, {_SPLIT.format(c='b')} as h from x),
    dp(conv_id, turn, v, i, row_, r, h) as (select conv_id, turn, v, 0::bigint, range(0, len(h) + 1), r, h from p
      union all select conv_id, turn, v, i + 1, list_reduce(range(1, len(h) + 1), lambda acc, j: list_append(acc, least(acc[len(acc)] + 1, row_[j + 1] + 1, row_[j] + (case when r[i + 1] = h[j] then 0 else 1 end))), [i + 1]), r, h from dp where i < len(r)),
    g as (select v as variant, sum(row_[len(h) + 1])::bigint as errors, sum(len(r))::bigint as words, round(sum(row_[len(h) + 1])::double / sum(len(r)), 8) as rate from dp where i = len(r) group by v)
    select *, round((b - rate) / b * 100, 6) as improvement from (select g.*, (select rate from g where variant = 'none') as b from g) where b <> 0""".replace("select *, round", "select variant, errors, words, rate, round"))
def wer_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return errorrate.breakdown(views.turn_pairs(spark, sf), errorrate.variants(".,?-"))


@query()
def wer_standardised(spark: SparkSession, sf: str) -> DataFrame:
    return errorrate.text_error_rate(views.turn_pairs(spark, sf), ["conv_id"], standard=t.wer_standard())


@query(_distance_sql(r"string_split(trim(lower({c})), ' ')").format(cols="round(100 * sum(e)::double / sum(n), 4) as percent, sum(e)::bigint as errors, sum(n)::bigint as words", rest=""))
def ctm_wer(spark: SparkSession, sf: str) -> DataFrame:
    pairs = views.turn_pairs(spark, sf).withColumn("file", F.col("conv_id") * 1000 + F.col("turn"))
    side = lambda c: pairs.select("file", F.col(c).alias("transcript"))
    return errorrate.ctm_error_rate(side("ref"), side("hyp"), F.lower)


@query("select round(avg(m), 8) as mean from (select avg(value) as m from events group by user_id % 8)")
def worker_loss(spark: SparkSession, sf: str) -> DataFrame:
    return errorrate.worker_mean(table(spark, sf, "events").select(F.expr("user_id % 8").alias("worker"), F.col("value").alias("loss")))


@query(_distance_sql(_SPLIT).format(cols="conv_id, turn, e as errors, n as words, round(case when n > 0 then e::double / n else 'inf'::double end, 8) as rate", rest=""))
def wer_reports(spark: SparkSession, sf: str) -> DataFrame:
    return errorrate.reports(_turn_tokens(spark, sf, "wer")).select("conv_id", "turn", F.col("errors").cast("long").alias("errors"), "words", "rate")


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    norm = lambda c: t.normalise_punctuation(F.col(c))
    return errorrate.mark_operations(views.turn_pairs(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("utt"), norm("ref").alias("ref"), norm("hyp").alias("hyp")))


_MARK_TOKENS = "regexp_extract_all(translate(replace({c}, '\"', ''), ';:!-', ',.. '), '[\\p{{L}}\\p{{N}}_'']+|[,.?]')"
_MASKED = "list_transform({c}, lambda x: case when x in (',', '.', '?') then '' else x end)"
#: The table of distances, all its rows kept, and the path back from its end.
_MARKED = f"""with recursive p as (select conv_id * 1000 + turn as utt, {_MARK_TOKENS.format(c='ref')} as rt, {_MARK_TOKENS.format(c='hyp')} as ht from ({TURNS})),
    q as (select utt, rt, ht, {_MASKED.format(c='rt')} as r, {_MASKED.format(c='ht')} as h from p),
    dp(utt, i, row_, r, h) as (select utt, 0::bigint, range(0, len(h) + 1), r, h from q
      union all select utt, i + 1, list_reduce(range(1, len(h) + 1), lambda acc, j: list_append(acc, least(acc[len(acc)] + 1, row_[j + 1] + 1, row_[j] + (case when r[i + 1] = h[j] then 0 else 1 end))), [i + 1]), r, h from dp where i < len(r)),
    tr(utt, i, j, op) as (select utt, len(r)::bigint, len(h)::bigint, '' from q
      union all select utt, i - (op <> 'I')::int, j - (op <> 'D')::int, op from (select tr.utt, tr.i, tr.j, case when tr.i > 0 and tr.j > 0 and c.r[tr.i] = c.h[tr.j] then 'C' when tr.i > 0 and tr.j > 0 and c.row_[tr.j + 1] = b.row_[tr.j] + 1 then 'S'
        when tr.j > 0 and (tr.i = 0 or c.row_[tr.j + 1] = c.row_[tr.j] + 1) then 'I' else 'D' end as op from tr join dp c on c.utt = tr.utt and c.i = tr.i left join dp b on b.utt = tr.utt and b.i = tr.i - 1 where tr.i + tr.j > 0)),
    t as (select tr.utt, tr.op, case when op <> 'I' then rt[i + 1] end as x, case when op <> 'D' then ht[j + 1] end as y from tr join q on q.utt = tr.utt where op <> ''),
    ops as (select utt, x as mark, y as hyp_mark, case when x = y then 'Correct' else 'Substitutions' end as op from t where op = 'C' and x in (',', '.', '?')
      union all select utt, x, null, 'Deletions' from t where op in ('S', 'D') and x in (',', '.', '?') union all select utt, y, null, 'Insertions' from t where op in ('S', 'I') and y in (',', '.', '?')) """


@query(_MARKED + "select coalesce(sum(n), 0)::bigint as n, coalesce(sum(wrong), 0)::bigint as errors, coalesce(sum(wrong) / sum(n)::double, 0.0::double) as per from (select utt, count(*) as n, count(*) filter (op <> 'Correct') as wrong from ops group by utt)")
def punct_error_rate(spark: SparkSession, sf: str) -> DataFrame:
    return errorrate.punctuation_error_rate(_marked(spark, sf))


@query(_MARKED + "select mark, count(*) as n, " + ", ".join(f"round(count(*) filter (op = '{o}') / count(*)::double, 8) as {o.lower()}" for o in ("Correct", "Deletions", "Insertions", "Substitutions")) + ", round(1 - count(*) filter (op = 'Correct') / count(*)::double, 8) as per from ops group by rollup (mark)")
def punct_mark_rates(spark: SparkSession, sf: str) -> DataFrame:
    return errorrate.mark_rates(_marked(spark, sf))


@query(_MARKED + "select mark, hyp_mark, count(*) as n from ops where hyp_mark is not null group by mark, hyp_mark")
def punct_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).where("hyp_mark is not null").groupBy("mark", "hyp_mark").agg(F.count("*").alias("n"))


# curation


def _filter(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: curate.by_length(views.manifest(spark, sf), mode, 200.0, 2500, 2.0).select("utt", "fname", F.round("duration", 8).alias("duration"))


for _mode, _rule in (("manifest", "duration <= 200 and duration > 2 and length(transcript) < 2500"), ("shard", "duration <= 200 and duration >= 2 and length(transcript) <= 2500"), ("hub", "duration < 200 and duration > 2 and length(transcript) < 2500")):
    QUERIES[f"manifest_filter_{_mode}"] = _filter(_mode)
    ORACLE_SQL[f"manifest_filter_{_mode}"] = f"select utt, fname, round(duration, 8) as duration from ({MANIFEST}) where {_rule}"


@query(f"""with m as ({MANIFEST}), f as (select fname, case when utt % 11 = 0 then duration + 1 else duration end as d, case when utt % 13 = 0 then num_samples + 1 else num_samples end as n from m where utt % 17 <> 0)
    select coalesce(reason, 'valid') as reason, count(*) as n from (select case when f.fname is null then 'missing file' when trim(transcript) = '' then 'empty transcript' when duration <> d then 'duration differs' when num_samples <> f.n then 'samples differ' when count(*) over (partition by m.fname) > 1 then 'duplicate file' end as reason from m left join f using (fname)) group by 1""")
def manifest_validate(spark: SparkSession, sf: str) -> DataFrame:
    m = views.manifest(spark, sf)
    files = m.where("utt % 17 <> 0").select("fname", F.expr("if(utt % 11 = 0, duration + 1, duration)").alias("duration"), F.expr("if(utt % 13 = 0, num_samples + 1, num_samples)").alias("num_samples"))
    return curate.validated(m, files).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query("select text, count(*) as n from documents group by text having count(*) > 1")
def manifest_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return curate.duplicates(table(spark, sf, "documents"), "text")


@query("select manifest, n, duration, round(duration / n, 6) as mean from (select source as manifest, count(*) as n, round(sum(n_chars / 15.0::double), 4) as duration from documents group by source)")
def manifest_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.manifest_sizes(views.manifest(spark, sf)).select("manifest", "n", F.round("duration", 4).alias("duration")).withColumn("mean", F.round(F.col("duration") / F.col("n"), 6))


@query(f"select round(avg(duration), 8) as mean, count(*) as n from ({MANIFEST}) where duration <= 200")
def mean_duration(spark: SparkSession, sf: str) -> DataFrame:
    return views.manifest(spark, sf).where("duration <= 200").agg(F.round(F.avg("duration"), 8).alias("mean"), F.count("*").alias("n"))


@query(f"select max(duration) as longest, max(duration) * 64 as product, max(duration) * 64 <= 1.5e5 as fits from ({MANIFEST})")
def batch_guard(spark: SparkSession, sf: str) -> DataFrame:
    return curate.batch_guard(views.manifest(spark, sf), 64)


@query(f"select utt, fname, row_number() over (order by manifest, utt) - 1 as label from ({MANIFEST}) where duration > 2")
def label_assign(spark: SparkSession, sf: str) -> DataFrame:
    return curate.labelled(views.manifest(spark, sf).where("duration > 2"), ["manifest", "utt"]).select("utt", "fname", "label")


@query(f"select utt, fname from (select *, row_number() over (partition by manifest order by md5('1|' || fname), fname) as r, count(*) over (partition by manifest) as n from ({MANIFEST})) where r <= floor(n * 0.25::double)")
def subset_exact_n(spark: SparkSession, sf: str) -> DataFrame:
    return curate.subset(views.manifest(spark, sf), 0.25).select("utt", "fname")


@query(f"select l.doc_id as label, m.fname from labels l left join (select utt, fname from ({MANIFEST})) m on m.utt = l.doc_id")
def label_names(spark: SparkSession, sf: str) -> DataFrame:
    m = views.manifest(spark, sf).select(F.col("utt").alias("label"), "fname")
    return curate.file_names(table(spark, sf, "labels").select(F.col("doc_id").alias("label")), m)


@query("select d.doc_id, d.lang, l.quality from documents d join labels l using (doc_id)")
def pair_inner(spark: SparkSession, sf: str) -> DataFrame:
    # counted: unmatched rows of both sides come with the same pass
    return curate.paired(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", Observation())


@query("select doc_id, 'left' as side from (select doc_id from documents except select doc_id from labels) union all select doc_id, 'right' as side from (select doc_id from labels except select doc_id from documents)")
def pair_missing(spark: SparkSession, sf: str) -> DataFrame:
    return curate.unmatched(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("select text, source, doc_id from (select *, row_number() over (partition by text order by source desc, doc_id desc) as r from documents) where r = 1")
def union_later_wins(spark: SparkSession, sf: str) -> DataFrame:
    return curate.later_wins(table(spark, sf, "documents").select("text", "source", "doc_id"), "text", ["source", "doc_id"])


# mixing and order

_SIZES = "select source as manifest, count(*) as n, sum(n_chars / 15.0::double) as duration from documents group by source"
_RATIO = "(cast(substr(manifest, 4) as int) % 3 + 1)"
_FRACS = {"none": "n::double", "relative": f"({_RATIO} * n)::double", "absolute": f"{_RATIO}::double", "canary": "n / duration * pow(duration / sum(duration) over (), 0.5::double)"}


def _fractions(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    sizes = sampling.manifest_sizes(views.manifest(spark, sf))
    ratio = F.expr("cast(substring(manifest, 4) as int) % 3 + 1")
    return sampling.fractions(sizes, mode, ratio, 0.5)


def _mix(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: sampling.epoch_sizes(_fractions(spark, sf, mode), 4).select("manifest", "n", F.round("frac", 8).alias("frac"), "utts", "repetition")


def _epoch_sql(mode: str) -> str:
    return f"""select manifest, n, frac, utts, case when utts > 0 then ceil(n / utts::double)::bigint end as repetition from (select manifest, n, round(frac, 8) as frac, cast(floor(floor(target * min(n / target) over () + 1e-9) / 4) * 4 as bigint) as utts
    from (select *, frac / sum(frac) over () as target from (select *, {_FRACS[mode]} as frac from ({_SIZES}))))"""


for _mode in _FRACS:
    QUERIES[f"mix_{_mode}"] = _mix(_mode)
    ORACLE_SQL[f"mix_{_mode}"] = _epoch_sql(_mode)


@query(f"""with e as ({_epoch_sql('relative')}), m as (select manifest, fname, row_number() over (partition by manifest order by md5('1|' || fname), fname) - 1 as r from ({MANIFEST})),
    p as (select manifest, fname, r + c * n as place, utts from m join e using (manifest), unnest(range(0, floor((3 * utts - 1) / n::double)::bigint + 1)) as u(c) where utts > 0)
    select cast(place // utts as int) as epoch, manifest, fname from p where place < 3 * utts""")
def epoch_plan(spark: SparkSession, sf: str) -> DataFrame:
    sizes = sampling.epoch_sizes(_fractions(spark, sf, "relative"), 4)
    return sampling.epochs(views.manifest(spark, sf), sizes.select("manifest", "n", "utts"), 3).select("epoch", "manifest", "fname")


@query(f"""with m as ({MANIFEST}), o as (select fname, duration, row_number() over (order by duration, md5('1|' || fname), fname) - 1 as rn, ceil(ceil(count(*) over () / 6.0) / 8)::bigint * 8 as size from m),
    b as (select fname, rn // size as bucket, row_number() over (partition by rn // size order by md5('2|' || fname), fname) - 1 as k from o)
    select fname, bucket, k // 8 as batch, md5('3|' || bucket || '|' || (k // 8)) as batch_order from b""")
def bucket_plan(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.bucketed(views.manifest(spark, sf), 6, 8).select("fname", "bucket", "batch", "batch_order")


@query(f"select fname, place, (place % 4)::int as worker from (select fname, row_number() over (order by duration desc, fname) - 1 as place from ({MANIFEST}))")
def rank_stride(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.striped(views.manifest(spark, sf), 4).select("fname", "place", "worker")


def _ordered(spark: SparkSession, sf: str) -> DataFrame:
    return indexed(views.manifest(spark, sf).withColumn("k", seeded(5, "fname")), ["k", "fname"], "place").select("fname", "num_samples", F.col("num_samples").alias("duration"), "place")


_ORDERED = f"select fname, num_samples, row_number() over (order by md5('5|' || fname), fname) - 1 as place from ({MANIFEST})"


@query(f"""with o as ({_ORDERED}), c as (select place // 16 as chunk, sum(num_samples) as s from o group by 1), b as (select chunk as best from c order by s desc, chunk limit 1)
    select fname, case when place // 16 = best then place - best * 16 when place // 16 = 0 then place + best * 16 else place end as place from o, b""")
def safety_batch(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.longest_first(_ordered(spark, sf), 16).select("fname", "place")


@query()
def pessimistic_order(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.pessimistic(_ordered(spark, sf), (64, 32, 8)).select("fname", "place")


@query(f"select fname, (b * 100 + row_number() over (partition by b order by md5('9|' || fname), place) - 1)::bigint as place from (select *, place // 100 as b from ({_ORDERED}))")
def buffer_order(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.in_buffers(_ordered(spark, sf), 100, [seeded(9, "fname")]).select("fname", "place")


@query(f"select fname, (b * 64 + row_number() over (partition by b order by num_samples, place) - 1)::bigint as place from (select *, place // 64 as b from ({_ORDERED}))")
def buffer_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.in_buffers(_ordered(spark, sf), 64, [F.col("duration")]).select("fname", "place")


@query(f"select fname, place from ({_ORDERED}) where place // 16 = 3")
def nth_batch(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.nth_batch(_ordered(spark, sf), 16, 3).select("fname", "place")


@query(f"select fname, place, ((place // 8) % 4)::int as worker, (place // 32) * 8 + place % 8 as turn from ({_ORDERED}) where (place // 32) * 8 + place % 8 >= 16")
def shard_resume(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.resumed(_ordered(spark, sf), 4, 8, 2).select("fname", "place", "worker", "turn")


@query(f"select fname, num_samples from ({MANIFEST}) order by duration desc, fname limit 25")
def longest_utterances(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.longest(views.manifest(spark, sf), 25).select("fname", "num_samples")


@query("""select event_id, round(20 + (0 - 20) * f, 6) as low, round(20 + (10 - 20) * f, 6) as high, round(0.2 + 0.8 * f, 6) as blend from (select event_id, greatest(0.0::double, least(1.0::double, (event_id - 2000) / 5000.0::double)) as f from events)""")
def step_schedules(spark: SparkSession, sf: str) -> DataFrame:
    low, high = sampling.snr_schedule(F.col("event_id"), 2000, 5000, 20.0, 0.0, 10.0)
    blend = sampling.blend_schedule(F.col("event_id"), 2000, 5000, 0.2)
    return table(spark, sf, "events").select("event_id", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.round(blend, 6).alias("blend"))


# text


def _text(name: str, rule: Callable, sql: str, source: str = "documents", key: str = "doc_id") -> None:
    QUERIES[name] = lambda spark, sf: spread(table(spark, sf, source)).select(*key.split(", "), rule(F.col("text")).alias("text"))
    ORACLE_SQL[name] = f"select {key}, {sql} as text from {source}"


def _fold_sql(sql: str, rules: list[tuple[str, str]], flags: str = "g") -> str:
    for a, b in rules:
        q = lambda s: s.replace("'", "''")
        sql = f"regexp_replace({sql}, '{q(a)}', '{q(b)}', '{flags}')"
    return sql


_text("text_punct_norm", t.normalise_punctuation, "translate(replace(text, '\"', ''), ';:!-', ',.. ')")
_text("text_tags", t.remove_tags, r"regexp_replace(text, '<[a-zA-Z_]+>', '', 'g')")
_text("text_scrub", lambda c: t.scrub(F.lower(c), CHARSET), r"regexp_replace(lower(text), '[^ ''a-z]', '', 'g')")
_text("text_abbreviations", t.expand_abbreviations, _fold_sql("text", [(rf"(^|[^\p{{L}}\p{{N}}_]){a}\.", rf"\1{b}") for a, b in t.ABBREVIATIONS], "gi"))
_text("text_symbols", lambda c: t.collapse(t.expand_symbols(c)), r"regexp_replace(replace(replace(replace(replace(replace(text, '&', ' and '), '+', ' plus '), '%', ' percent '), '@', ' at '), ':', ' '), '[ \t\n\x0B\f\r]+', ' ', 'g')")
_text("text_by_line", t.by_line, r"array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), ' ')")
_text("text_sentence_ends", lambda c: t.sentence_ends(c)[0], r"regexp_replace(text, '([.?!]+)[ \t\n\x0B\f\r]+([^ \t\n\x0B\f\r])', '\1 <EOS> \2', 'g')")


def _standard_sql(c: str) -> str:
    q = lambda x: x.replace("'", "''")
    r = lambda sql, a, b: f"regexp_replace({sql}, '{q(a)}', '{q(b)}', 'g')"
    sql = f"lower({c})"  # letters are folded first: then its word boundaries, which know ASCII only, fall where ours do
    for a, b in t.LETTERS:
        sql = f"replace({sql}, '{a}', '{b}')"
    sql = r(r(r(f"strip_accents({sql})", r"[<\[][^>\]]*[>\]]", ""), t.FILLERS, ""), r"\s+'", "'")
    for a, b in (*t.CONTRACTIONS, (r"(\d),(\d)", r"\1\2"), (r"\.([^0-9]|$)", r" \1")):
        sql = r(sql, a, b)
    sql = r(sql, r"[^\p{L}\p{N}\s.%$¢€£']", " ")
    words = f"array_to_string(list_transform(list_filter(string_split_regex({sql}, '\\s+'), lambda x: x <> ''), lambda x: case x when 'normalise' then 'normalize' when 'centralised' then 'centralized' else x end), ' ')"
    return r(r(r(words, r"[.$¢€£]([^0-9])", r" \1"), r"([^0-9])%", r"\1 "), r"\s+", " ")


@query(f"select conv_id, turn, {_standard_sql('text')} as text from conversations")
def text_standardise(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "conversations")).select("conv_id", "turn", t.standardise(F.col("text"), {"normalise": "normalize", "centralised": "centralized"}).alias("text"))


@query()
def text_lowercase(spark: SparkSession, sf: str) -> DataFrame:
    return t.normalise(spread(table(spark, sf, "documents").select("doc_id", "text")), "text", "lowercase", CHARSET)


@query("select ch as char, count(*) as n, contains(' ''abcdefghijklmnopqrstuvwxyz', ch) as covered from (select unnest(string_split(text, '')) as ch from documents) where ch <> '' group by ch")
def charset_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return lm.charset_coverage(table(spark, sf, "documents"), CHARSET)


@query(r"select lang, count(*) as n, count(*) filter (where regexp_matches(text, '[^\x00-\x7F]')) as odd from documents group by lang")
def non_ascii_audit(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(t.non_ascii(F.col("text"))).alias("odd"))


# timing

_LINES = "select event_id as line, user_id % 3 as file, event_type as word, row_number() over (order by event_id) - row_number() over (partition by user_id % 3 order by event_id) as g from events"


@query(f"""with l as ({_LINES}), last as (select file, max(line) as m from l group by file), k as (select l.file, l.g from l join last on l.file = last.file and l.line = last.m)
    select l.file, string_agg(word, ' ' order by line) as transcript, count(*) as n_words from l join k on l.file = k.file and l.g = k.g group by l.file""")
def ctm_islands(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "events").select(F.col("event_id").alias("line"), F.expr("user_id % 3").alias("file"), F.col("event_type").alias("word"))
    return timing.transcripts(lines)


@query(f"select file, array_to_string({WORDS.format(c='text')}, ' ') as transcript, len({WORDS.format(c='text')}) as n_words from (select doc_id as file, text from documents) where len({WORDS.format(c='text')}) > 0")
def ctm_transcript(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("seq", "word")))
    d = timing.runs(views.ref_ctm(spark, sf), "file", "seq", "word", " ").groupBy("file")
    return d.agg(F.array_join(F.transform(parts, lambda r: r["word"]), " ").alias("transcript"), F.sum("n").alias("n_words"))


_DELTAS = f"select file, seq, length(word) % 4 as kind, round(0.05::double + {LATE} / 100.0::double, 6) as x from ({CTM})"


def _deltas(spark: SparkSession, sf: str) -> DataFrame:
    r, h = views.ref_ctm(spark, sf), views.hyp_ctm(spark, sf).select("file", "seq", F.col("start").alias("h"))
    return r.join(h, ["file", "seq"]).select("file", "seq", (F.char_length("word") % 4).alias("kind"), F.round(F.col("h") - F.col("start"), 6).alias("latency"))


@query(f"""with d as ({_DELTAS}), s as (select kind, count(*) as n, round(avg(y), 6) as mean, round(stddev_pop(y), 6) as stdev, round(median(y), 6) as median from (select kind, round(x - 0.03, 6) as y from d) group by kind),
    o as (select kind, round(x - 0.03, 6) as y, row_number() over (partition by kind order by x) - 1 as r from d)
    select s.kind, n, mean, stdev, median, max(case when r = floor(n * 90 / 100)::bigint then y end) as p90, max(case when r = floor(n * 99 / 100)::bigint then y end) as p99 from s join o using (kind) group by all""")
def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    return timing.latency_summary(_deltas(spark, sf), ["kind"], 0.06)


@query(f"""with d as ({_DELTAS}), m as (select kind, median(x) as h from d group by kind)
    select kind, round(avg(abs(x)), 6) as raw_shift, round(avg(abs(x - 0.1)), 6) as fixed_shift, round(avg(abs(x - h)), 6) as corrected_shift, round(max(h), 6) as head_offset, round(max(h), 6) as tail_offset from d join m using (kind) group by kind""")
def timestamp_shift(spark: SparkSession, sf: str) -> DataFrame:
    d = _deltas(spark, sf).select("kind", F.col("latency").alias("head"), F.col("latency").alias("tail"))
    return timing.timestamp_shift(d, ["kind"], 0.1, 0.1)


def _blocks_sql(words: str) -> str:
    """Longest matching blocks of words (file, a, b: lists): rect holds what is not aligned yet, each round its longest common runs."""
    return f"""with recursive w as ({words}), m as (select file, u.i, v.j from w, unnest(range(1, len(a) + 1)) as u(i), unnest(range(1, len(b) + 1)) as v(j) where a[u.i] = b[v.j]),
    d as (select *, i - row_number() over (partition by file, j - i order by i) as run from m), l as (select file, i, j, count(*) over (partition by file, j - i, run order by i desc) as n from d),
    rect(file, al, ah, bl, bh, i, j, n) as (select file, 1::bigint, len(a)::bigint, 1::bigint, len(b)::bigint, null::bigint, null::bigint, null::bigint from w
      union all select file, case when side = 2 then i + n else al end, case when side = 1 then i - 1 else ah end, case when side = 2 then j + n else bl end, case when side = 1 then j - 1 else bh end, case when side = 0 then i end, case when side = 0 then j end, case when side = 0 then n end
        from (select r.file, al, ah, bl, bh, unnest([0, 1, 2]) as side, max((least(l.n, ah - l.i + 1, bh - l.j + 1), -l.i, -l.j)) as best, -best[2] as i, -best[3] as j, best[1] as n from rect r join l on l.file = r.file and l.i between al and ah and l.j between bl and bh where r.n is null group by r.file, al, ah, bl, bh)),
    k as (select file, i, j, n from rect where n is not null union all select file, len(a) + 1, len(b) + 1, 0 from w),
    g as (select *, coalesce(lag(i + n) over s, 1) as pi, coalesce(lag(j + n) over s, 1) as pj from k window s as (partition by file order by i, n desc)),
    e as (select file, i + x as i, j + x as j, true as same from k, unnest(range(0, n)) as u(x) union all select file, pi + x, pj + x, false from g, unnest(range(0, case when i - pi = j - pj then i - pi else 0 end)) as u(x)) """


_TURN_WORDS = f"select conv_id * 1000 + turn as file, {_SPLIT.format(c='ref')} as a, {_SPLIT.format(c='hyp')} as b from ({TURNS})"


@query(_blocks_sql(_TURN_WORDS) + "select file, i - 1 as ref_seq, j - 1 as hyp_seq, case when same then a[i] end as word from e join w using (file)")
def word_alignment(spark: SparkSession, sf: str) -> DataFrame:
    pairs = views.turn_pairs(spark, sf)
    side = lambda c: pairs.select((F.col("conv_id") * 1000 + F.col("turn")).alias("file"), F.posexplode(errorrate.word_list(F.col(c))).alias("seq", "word"))
    return timing.aligned_words(side("ref"), side("hyp"))


def _basic(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z' ]", "")


def _turn_words(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Words of both sides of turn pairs with times: 0.3 s apart, the hypothesis 0.1 s late."""
    pairs = views.turn_pairs(spark, sf).withColumn("file", F.col("conv_id") * 1000 + F.col("turn"))
    side = lambda c, late: pairs.select("file", F.posexplode(errorrate.word_list(F.col(c))).alias("seq", "word")).select("file", "seq", "word", (F.col("seq") * 0.3 + late).alias("start"), F.lit(0.25).alias("duration"))
    return side("ref", 0.0), side("hyp", 0.1)


_SPOKEN_WORDS = "list_transform(list_filter({c}, lambda x: not regexp_full_match(x, '<[a-zA-Z_]+>')), lambda x: regexp_replace(lower(x), '[^a-z'' ]', '', 'g'))"


@query(_blocks_sql(f"select file, {_SPOKEN_WORDS.format(c='a')} as a, {_SPOKEN_WORDS.format(c='b')} as b from ({_TURN_WORDS}) where len(a) > 0 and len(b) > 0")
    + "select round(case when words > 0 then pairs / words::double else 0.0::double end, 8) as token_usage, round(case when words > 0 then ends / files::double else 0.0::double end, 8) as terminal_usage from (select count(*) as pairs from e where same), (select sum(len(a)) as words, count(*) as files, count(*) filter (coalesce(a[len(a)], '') = coalesce(b[len(b)], '')) as ends from w)")
def usage_rates(spark: SparkSession, sf: str) -> DataFrame:
    ref, hyp = _turn_words(spark, sf)
    spoken = [timing.spoken_words(x, _basic) for x in (ref, hyp)]
    return timing.usage_rates(timing.aligned_words(*spoken, substitutions=False), ref, hyp, _basic)


_LAST = f"""select doc_id as file, {WORDS.format(c='text')} as w from documents"""
_BASIC = "regexp_replace(lower({c}), '[^a-z'' ]', '', 'g')"
_ENDS = f"""select file, {_BASIC.format(c='w[len(w)]')} = case when file % 3 = 0 then 'other' else {_BASIC.format(c='w[len(w)]')} end as agree, (len(w) - 1) * 0.3::double + 0.25 as ref_end from ({_LAST}) where len(w) > 0"""


def _last_words(spark: SparkSession, sf: str) -> DataFrame:
    hyp = views.hyp_ctm(spark, sf).withColumn("word", F.expr("if(file % 3 = 0, 'other', word)"))
    return timing.last_words(views.ref_ctm(spark, sf), hyp, _basic)


@query(f"select file, agree, round(ref_end, 6) as ref_end from ({_ENDS})")
def terminal_words(spark: SparkSession, sf: str) -> DataFrame:
    return _last_words(spark, sf).withColumn("ref_end", F.round("ref_end", 6))


@query(f"select file, case when file % 4 = 1 then 'EOS' else 'Silence' end as kind, round(case when file % 4 = 1 then 100.0::double + file % 7 else 200.0::double end - ref_end, 6) as latency from ({_ENDS}) where agree and file % 4 in (1, 2)")
def endpoint_latency(spark: SparkSession, sf: str) -> DataFrame:
    ends = table(spark, sf, "documents").select(F.col("doc_id").alias("file"), F.expr("case doc_id % 4 when 1 then 'EOS' when 2 then 'Silence' else 'Never' end").alias("kind"), F.expr("case doc_id % 4 when 1 then 100D + doc_id % 7 when 2 then 200D end").alias("final_time"))
    return timing.endpoint_latencies(_last_words(spark, sf), ends)


@query(f"""with p as (select doc_id as utt, i - 1 as pos, substr(text, i, 1) as piece, i * 3 as frame from (select doc_id, replace(text, chr(10), ' ') as text from documents) d, unnest(range(1, length(text) + 1)) as u(i)),
    w as (select *, sum(case when piece = ' ' or pos = 0 then 1 else 0 end) over (partition by utt order by pos) - 1 as word_no from p)
    select lang, count(*) as n_words, sum(stop - start)::bigint as span from (select utt, word_no, min(frame) as start, max(frame) as stop from w group by all) join documents on doc_id = utt group by lang""")
def token_words(spark: SparkSession, sf: str) -> DataFrame:
    pieces = F.array_remove(F.split(F.translate("text", "\n", " "), ""), "")
    d = spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("utt"), pieces.alias("pieces"))
    w = timing.token_words(d.withColumn("frames", F.transform("pieces", lambda _, i: (i + 1) * 3)))
    each = w.groupBy("utt").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("span"))
    return each.join(table(spark, sf, "documents").select(F.col("doc_id").alias("utt"), "lang"), "utt").groupBy("lang").agg(F.sum("n").alias("n_words"), F.sum("span").cast("long").alias("span"))


_TERM = f"""select session, case when e is not null and (s is null or e <= s) then 'EOS' when s is not null then 'Silence' else 'Never' end as kind, round(case when e is not null and (s is null or e <= s) then e else s end, 6) as final_time
    from (select session, min(case when nx - ts > 86400 then ts + 86400 end) as s, min(case when kind = 'session_end' then ts end) as e from (select *, lead(ts) over (partition by session order by ts, seq) as nx from ({RESPONSES})) group by session)"""


@query(_TERM)
def terminations(spark: SparkSession, sf: str) -> DataFrame:
    return windows.terminations(views.responses(spark, sf), "session", 86400.0)


@query(f"select round(avg((kind = 'EOS')::int::double), 8) as eos, round(avg((kind = 'Silence')::int::double), 8) as silence, round(avg((kind = 'Never')::int::double), 8) as never, count(*) as n from ({_TERM})")
def endpoint_shares(spark: SparkSession, sf: str) -> DataFrame:
    return timing.endpoint_shares(windows.terminations(views.responses(spark, sf), "session", 86400.0))


# ends by mark, silence or forced finals: the fold over a table, and the same events as a stream

_DIGITS = "list_filter(string_split(({x})::varchar, ''), lambda c: c <> '')"
_SHARED = "len(list_filter(range(1, len(a) + 1), lambda i: a[1:i] = {b}[1:i]))"
_ENDINGS = f"""with recursive k as (select user_id as session, event_id as seq, epoch_us(ts) // 1000 as ms, event_type, coalesce(json_extract_string(props, '$.k')::int, 0) as k from events),
    h as (select session, seq, ms, case when event_type in ('view', 'click') then 'partial' when event_type = 'purchase' then 'final' when event_type = 'signup' then 'session_start' else 'session_end' end as kind,
        {_DIGITS.format(x="k")} as a, {_DIGITS.format(x="k - k % 10 + seq % 10")} as b, {_DIGITS.format(x="k * 7 % 100")} as c from k),
    n as (select *, {_SHARED.format(b="b")} as nb, {_SHARED.format(b="c")} as nc from h),
    e as (select session, ms, kind, row_number() over (partition by session order by ms, seq) as i, case when nb = 0 then 1 when nc = 0 then 2 else 3 end as n_kept, case when nb = 0 then a when nc = 0 then a[1:nb] else a[1:least(nb, nc)] end as prefix from n),
    f(session, i, last, since, ended, what, "at", n_kept, prefix) as (select session, 0::bigint, null::bigint, null::bigint, false, null::varchar, null::bigint, null::int, null::varchar[] from e where i = 1
        union all select session, i, case when what = 'Silence' then last else ms end, case when what = 'Forced' or kind = 'final' then ms else coalesce(since, ms) end, what in ('Silence', 'EOS') and what is not null, what,
            case when what = 'Silence' then last + 7200000 else ms end, case when what = 'Forced' then n_kept end, case when what = 'Forced' then prefix end
        from (select f.session, e.i, f.last, f.since, e.ms, e.kind, e.n_kept, e.prefix, case when e.ms - f.last > 7200000 then 'Silence' when e.kind = 'session_end' then 'EOS' when e.kind = 'partial' and e.ms - coalesce(f.since, e.ms) > 1800000 then 'Forced' end as what
            from f join e on e.session = f.session and e.i = f.i + 1 where not f.ended)),
    l as (select session, arg_max(last, i) as last, bool_or(ended) as ended from f group by session)
    select session, what as kind, "at" / 1000.0::double as "at", n_kept, prefix from f where what is not null
    union all select session, 'Silence', (last + 7200000) / 1000.0::double, null, null from l where not ended and (select max(epoch_us(ts) // 1000) from events) - last > 7200000"""


@query(_ENDINGS)
def endings(spark: SparkSession, sf: str) -> DataFrame:
    e = views.hypotheses(table(spark, sf, "events"))
    until = e.agg(F.max("event_time").alias("t"))
    return ends.endings(e, 7200.0, 1800.0, until.scalar())


@query(_ENDINGS)
def endings_on_stream(spark: SparkSession, sf: str) -> DataFrame:
    return drained(ends.endings_stream(views.hypotheses(_event_stream(spark, sf)), 7200.0, 1800.0, late="0 seconds", keep=1e9), "endings")


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    # a stream's path is a folder, or a pattern: the table may be one file
    return spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")


# streams, in their batch form


@query(f"select session, n, a = 'session_start' and z = 'session_end' as valid from (select session, count(*) as n, arg_min(kind, seq) as a, arg_max(kind, seq) as z from ({RESPONSES}) group by session)")
def session_valid(spark: SparkSession, sf: str) -> DataFrame:
    return windows.session_validity(views.responses(spark, sf), "session", "seq")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over w < interval 6 hour then 0 else 1 end as new from events window w as (partition by user_id order by ts)), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
    select user_id, min(ts) as start, max(ts) + interval 6 hour as stop, count(*) as n from s group by user_id, k""")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    s = windows.sessions(table(spark, sf, "events"), "user_id", "6 hours")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


@query("""select s as start, s + interval 15 minute as stop, count(*) as n, round(sum(value), 6) as total from (select value, make_timestamp((epoch_us(ts) // 720000000 - k) * 720000000) as s, ts from events, unnest(range(0, 2)) as u(k)) where ts < s + interval 15 minute group by s""")
def sliding_segments(spark: SparkSession, sf: str) -> DataFrame:
    s = windows.sliding(table(spark, sf, "events"), "15 minutes", "12 minutes")
    return s.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n", "total")


@query("select start, n, mean, v as p90 from (select time_bucket(interval 1 day, ts) as start, count(*) over w as n, round(avg(value) over w, 6) as mean, value as v, row_number() over (partition by time_bucket(interval 1 day, ts) order by value) as r from events window w as (partition by time_bucket(interval 1 day, ts))) where r = ceil(0.9 * n)")
def latency_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = windows.latency_windows(table(spark, sf, "events"), "1 day")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "mean", "p90")


@query(f"select session, round(max(ts - (t0 + i * 3600)), 6) as worst, count(*) filter (where ts - (t0 + i * 3600) > 0) as late from (select session, ts, row_number() over (partition by session order by ts, seq) - 1 as i, min(ts) over (partition by session) as t0 from ({RESPONSES})) group by session")
def lateness(spark: SparkSession, sf: str) -> DataFrame:
    return windows.lateness(views.responses(spark, sf), "session", 3600.0)


_PLACED = """r as ({responses}), o as (select *, coalesce(sum(case when kind = 'final' then length(text) else 0 end) over w, 0) as place, coalesce(sum(case when kind = 'final' then length(text) - length(replace(text, ' ', '')) else 0 end) over w, 0) as spaces
        from r window w as (partition by session order by ts, rank rows between unbounded preceding and 1 preceding)),
    c as (select session, kind, ts, rank, place + i - 1 as spot, i - 1 as i, text[i] as ch, spaces + length(text[1:i]) - length(replace(text[1:i], ' ', '')) as number, tokens from o, unnest(range(1, length(text) + 1)) as u(i)),
    m as (select f.session, f.spot, p.ts as pts, max(p.ch <> f.ch) over (partition by f.session, f.spot order by p.ts desc, p.rank desc rows unbounded preceding) as other, p.rank as prank
        from c f join c p on f.kind = 'final' and p.kind = 'partial' and p.session = f.session and p.spot = f.spot and (p.ts, p.rank) < (f.ts, f.rank)),
    s as (select session, spot, arg_min(pts, (pts, prank)) as since from m where not other group by session, spot)"""


@query(f"""with {_PLACED.format(responses=f"select session, ts, seq as rank, kind, coalesce(text, '') as text, null as tokens from ({RESPONSES}) where kind in ('partial', 'final')")}
    select session, string_agg(ch, '' order by c.spot) as word, greatest(0.0::double, max(coalesce(since, ts))) as ts from c left join s using (session, spot) where kind = 'final' and ch <> ' ' group by session, number""")
def fuse_words(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.words(views.responses(spark, sf))


_FRAMES = f"select session, seq as ts, (kind = 'partial')::int as rank, kind, [coalesce(text, ''), left(kind, 1 + (seq % 3)::int)] as tokens, coalesce(text, '') || left(kind, 1 + (seq % 3)::int) as text from ({RESPONSES}) where kind in ('partial', 'final')"


@query(f"""with {_PLACED.format(responses=_FRAMES)}, t as (select c.session, c.ts as frame, case when c.i < length(tokens[1]) then 0 else 1 end as pos, tokens, coalesce(since, c.ts) as since from c left join s using (session, spot) where kind = 'final')
    select session, frame, pos, tokens[pos + 1] as token, max(since) as since from t group by session, frame, pos, tokens""")
def fuse_tokens(spark: SparkSession, sf: str) -> DataFrame:
    r = views.responses(spark, sf).where("kind in ('partial', 'final')")
    return fusion.tokens(r.select("session", F.col("seq").alias("frame"), "kind", F.expr("array(coalesce(text, ''), left(kind, int(1 + seq % 3)))").alias("tokens")))


@query(f"select session, string_agg(text, '' order by ts, seq) as text from ({RESPONSES}) where kind = 'final' group by session")
def final_texts(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.finals(views.responses(spark, sf))


# segments


@query("select doc_id as utt, k as seg, k * 400 as first, least(k * 400 + 500, n) as last from (select doc_id, n_chars as n, case when n_chars < 500 then 1 else (n_chars - 100) // 400 + case when (n_chars - 100) % 400 > 0 then 1 else 0 end end as c from documents), unnest(range(0, c)) as u(k)")
def segment_plan(spark: SparkSession, sf: str) -> DataFrame:
    return segments.segments(table(spark, sf, "documents").select(F.col("doc_id").alias("utt"), F.col("n_chars").alias("n")), 500, 100)


def _merge_sql(segs: str, edge: int, hop: int, out: str) -> str:
    """The merge of segs (utt, seg, y, t: lists), a segment after the other, with its three looks written out."""
    look = "s0"
    for k in range(1, 4):
        look = f"""select * exclude (hit, p, q) replace (case when hit then list_concat(own[1:p - 1], own[p + 1:]) else own end as own, case when hit then trusted[q + 1:] else trusted end as trusted)
            from (select *, len(cut) >= {k} and list_contains(trusted, cut[{k}].y) as hit, list_position(list_transform(own, lambda o: o.y), cut[{k}].y) as p, list_position(trusted, cut[{k}].y) as q from ({look}))"""
    return f"""with recursive g as (select utt, seg, list_transform(range(1, len(y) + 1), lambda i: {{'y': y[i], 't': t[i]}}) as own, row_number() over (partition by utt order by seg) as i from ({segs})),
    f(utt, i, seg, own, last) as (select utt, i, seg, own, list_transform(own[greatest(len(own) - 2, 1):], lambda o: o.y) from g where i = 1
        union all select utt, i, seg, own, list_transform(own[greatest(len(own) - 2, 1):], lambda o: o.y) from (with s0 as (select utt, i, seg, cut, cut as own, trusted from (select g.utt, g.i, g.seg,
            g.own[coalesce(nullif(list_position(list_transform(g.own, lambda o: o.t >= {edge}), true), 0), len(g.own) + 1):] as cut, case when g.seg = f.seg + 1 then f.last else f.last[1:0] end as trusted from f join g on g.utt = f.utt and g.i = f.i + 1)) {look.replace("(s0)", "s0")})),
    o as (select utt, seg, u.i, own[u.i].y as y, own[u.i].t + seg * {hop} as t from f, unnest(range(1, len(own) + 1)) as u(i)) {out}"""


@query(_merge_sql(f"select utt, seg, w[first + 1:last] as y, range(0, last - first) as t from (select utt, w, k as seg, k * 48 as first, least(k * 48 + 60, n) as last, n from (select doc_id as utt, w, len(w) as n, case when len(w) < 60 then 1 else (len(w) - 12) // 48 + case when (len(w) - 12) % 48 > 0 then 1 else 0 end end as c from (select doc_id, list_transform({WORDS.format(c='text')}, lambda x: length(x)) as w from documents)), unnest(range(0, c)) as u(k)) where n > 0", 12, 48,
    "select utt, list(y::int order by seg, i) as tokens, list(t::bigint order by seg, i) as timestamps from o group by utt"))
def overlap_merge(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("utt"), F.transform(views.split_words(F.col("text")), lambda w: F.char_length(w)).alias("w"))
    plan = segments.segments(d.select("utt", F.size("w").alias("n")), 60, 12)
    s = plan.join(d, "utt").select("utt", "seg", F.expr("slice(w, first + 1, last - first)").alias("tokens"), F.expr("transform(sequence(0, greatest(last - first, 1) - 1), i -> i)").alias("timestamps"))
    return segments.merged(s.where("size(tokens) > 0"), 12, 1, hop=48)


_SPOKEN = "select user_id as utt, event_id as seq, epoch_us(ts) // 1000 as ms, (floor(value / 10)::int % 6)::int as token from events"
_SLID = "select utt, seg, list(token order by ms, seq) as y, list((ms - seg * 28800000) // 60000 order by ms, seq) as t from (select *, ms // 28800000 - k as seg from ({spoken}), unnest(range(0, 2)) as u(k)) where ms < seg * 28800000 + 36000000{closed} group by utt, seg"
_SLID_OUT = "select utt, t::bigint as t, y::int as token from o"


@query(_merge_sql(_SLID.format(spoken=_SPOKEN, closed=""), 120, 480, _SLID_OUT))
def sliding_merge(spark: SparkSession, sf: str) -> DataFrame:
    return overlaps.merged(views.spoken(table(spark, sf, "events")), 36000.0, 7200.0, 60.0)


@query(_merge_sql(_SLID.format(spoken=_SPOKEN, closed=" and seg * 28800000 + 36000000 <= (select max(epoch_us(ts) // 1000) from events)"), 120, 480, _SLID_OUT))
def sliding_merge_on_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same of the segments that the last event's time has closed."""
    return drained(overlaps.merged(views.spoken(_event_stream(spark, sf)), 36000.0, 7200.0, 60.0, late="0 seconds"), "merged")


@query("""with g as (select user_id as utt, ts, event_id, epoch_us(ts) // 1000000 as t, lag(epoch_us(ts) // 1000000) over w as p, row_number() over w - 1 as pos from events window w as (partition by user_id order by event_id)), f as (select utt, min(pos) as first, arg_min(p, pos) as last from g where t - p > 43200 group by utt)
    select utt, count(*) as n, max(round((last + 1 + 43200) * 1.0::double, 6)) as final_time from g left join f using (utt) where first is null or pos < first group by utt""")
def silence_cut(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("utt"), F.col("event_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    tokens = ranked(e, ["utt"], ["event_id"], "pos")
    return segments.silence_cut(tokens, 43200.0, 1.0).groupBy("utt").agg(F.count("*").alias("n"), F.max("final_time").alias("final_time"))


# language models and keywords


@query(f"select gram, count(*) as c from (select array_to_string(w[i:i + 2], ' ') as gram from (select {WORDS.format(c='text')} as w from documents) d, unnest(range(1, len(w) - 1)) as u(i)) group by gram")
def ngram_counts(spark: SparkSession, sf: str) -> DataFrame:
    return lm.ngrams(spread(table(spark, sf, "documents"), 16).select(views.split_words(F.col("text")).alias("words")), 3)


def _model(spark: SparkSession, sf: str) -> packed.Model:
    return packed.count_grams(spread(table(spark, sf, "documents")).select(views.split_words(F.col("text")).alias("words")), 4)


def _order_sql(n: int, counts: str) -> str:
    """CTEs of one order over counts (context, word, tail, c): its discounts, contexts and probabilities."""
    return f"""k{n} as (select count(*) filter (where c = 1) as n1, count(*) filter (where c = 2) as n2, count(*) filter (where c = 3) as n3, count(*) filter (where c = 4) as n4 from {counts}),
    e{n} as (select 1 - 2 * y * n2 / n1::double as d1, 2 - 3 * y * n3 / n2::double as d2, 3 - 4 * y * n4 / n3::double as d3 from (select *, n1 / (n1 + 2 * n2)::double as y from k{n})),
    d{n} as (select case when ok then d1 else 0.5 end as d1, case when ok then d2 else 1.0 end as d2, case when ok then d3 else 1.5 end as d3 from (select *, coalesce(isfinite(d1) and isfinite(d2) and isfinite(d3) and d1 between 0 and 1 and d2 between 0 and 2 and d3 between 0 and 3, false) as ok from e{n})),
    b{n} as (select g.*, case when c = 1 then d1 when c = 2 then d2 else d3 end as off from {counts} g, d{n}), t{n} as (select context, sum(c) as total, sum(off) / sum(c) as backoff from b{n} group by context),
    p{n} as (select b.context, b.word, b.context || ' ' || b.word as gram, (c - off) / total + backoff * l.p as p from b{n} b join t{n} using (context) join p{n - 1} l on l.gram = b.tail)"""


_MODEL = f"""w as (select doc_id, i, w[i] as w from (select doc_id, {WORDS.format(c='text')} as w from documents) d, unnest(range(1, len(w) + 1)) as u(i)),
    n as (select w as a, lead(w, 1) over o as b, lead(w, 2) over o as c, lead(w, 3) over o as d from w window o as (partition by doc_id order by i)),
    g4 as (select a || ' ' || b || ' ' || c as context, d as word, b || ' ' || c || ' ' || d as tail, count(*) as c from n where d is not null group by a, b, n.c, d),
    x3 as (select distinct a, b, c from n where c is not null), x2 as (select distinct a, b from n where b is not null),
    g3 as (select split_part(tail, ' ', 1) || ' ' || split_part(tail, ' ', 2) as context, split_part(tail, ' ', 3) as word, split_part(tail, ' ', 2) || ' ' || split_part(tail, ' ', 3) as tail, count(*) as c from g4 group by g4.tail),
    g2 as (select b as context, x3.c as word, x3.c as tail, count(*) as c from x3 group by b, x3.c), g1 as (select b as word, count(*) as c from x2 group by b),
    p1 as (select null as context, word, word as gram, c / (select sum(c) from g1)::double as p from g1), {_order_sql(2, 'g2')}, {_order_sql(3, 'g3')}, {_order_sql(4, 'g4')}"""


@query(f"""with {_MODEL}
    select 1 as n, null as context, word, round(p, 8) as p from p1 union all select 2, context, word, round(p, 8) from p2 union all select 3, context, word, round(p, 8) from p3 union all select 4, context, word, round(p, 8) from p4""")
def ngram_model(spark: SparkSession, sf: str) -> DataFrame:
    return packed.model_rows(_model(spark, sf)).select("n", "context", "word", F.round("p", 8).alias("p"))


@query(f"""with {_MODEL}, s as (select utt, w[i] as word, case when i > 1 then w[i - 1] end as c2, case when i > 2 then w[i - 2] || ' ' || w[i - 1] end as c3, case when i > 3 then w[i - 3] || ' ' || w[i - 2] || ' ' || w[i - 1] end as c4
        from (select conv_id * 1000 + turn as utt, {WORDS.format(c='text')} as w from conversations) x, unnest(range(1, len(w) + 1)) as u(i)),
    j as (select utt, coalesce(p4.p, coalesce(t4.backoff, 1) * coalesce(p3.p, coalesce(t3.backoff, 1) * coalesce(p2.p, coalesce(t2.backoff, 1) * coalesce(p1.p, 1e-7)))) as p from s left join p1 on p1.word = s.word
        left join p2 on p2.context = c2 and p2.word = s.word left join t2 on t2.context = c2 left join p3 on p3.context = c3 and p3.word = s.word left join t3 on t3.context = c3 left join p4 on p4.context = c4 and p4.word = s.word left join t4 on t4.context = c4)
    select utt, count(*) as n, round(sum(ln(p)), 6) as log_prob from j group by utt""")
def ngram_score(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("utt"), views.split_words(F.col("text")).alias("words"))
    return packed.scored(words, _model(spark, sf), "utt")


@query()
def lm_text(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("utt"), "text")
    return tokens.lm_lines(texts, subword_vocabulary(spark, sf), "utt", F.lower, {"eos": "<EOS>"})


_FORCED = """select conv_id as utt, list_filter(string_split(text, ''), lambda x: x <> '') as tokens, turn::double as score, (conv_id % 3)::double as waited from conversations"""


@query(f"""with h as ({_FORCED}), b as (select utt, arg_max(tokens, (score, tokens)) as best from h group by utt),
    r as (select h.utt, waited, best, row_number() over w as rank, min(len(list_filter(range(1, least(len(tokens), len(best)) + 1), lambda i: tokens[1:i] = best[1:i]))) over w as common, count(*) over (partition by h.utt) as n from h join b using (utt) window w as (partition by h.utt order by score desc, tokens desc)),
    k as (select *, row_number() over (partition by utt order by rank desc) as last from r where (waited > 1 and common > 0) or (waited <= 1 and rank = n) or rank = 1)
    select utt, rank as n_kept, common as n_prefix, best[1:common] as prefix from k where last = 1""")
def forced_prefix(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "conversations").select(F.col("conv_id").alias("utt"), fusion.characters(F.col("text")).alias("tokens"), F.col("turn").cast("double").alias("score"), (F.col("conv_id") % 3).cast("double").alias("waited"))
    return lm.forced_prefix(d, 1.0).select("utt", F.col("n_kept").cast("long").alias("n_kept"), F.col("n_prefix").cast("long").alias("n_prefix"), "prefix")


@query()
def subword_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return lm.subwords(spread(table(spark, sf, "documents")).select(views.split_words(F.lower("text")).alias("words")), 500)


@query(f"""with k as ({KEYWORDS}), t as (select doc_id, lower(text) as x from documents),
    p as (select doc_id, x, phrase, weight, length(phrase) as n from t, k)
    select doc_id, round(sum(weight * (n * (case when contains(x, phrase) then len(list_filter(range(1, length(x) - n + 2), lambda i: x[i:i + n - 1] = phrase)) else 0 end) + list_sum(list_transform(range(1, n), lambda i: case when ends_with(x, phrase[1:i]) then i else 0 end)))), 6) as score from p group by doc_id""")
def keyword_score(spark: SparkSession, sf: str) -> DataFrame:
    d = spread(table(spark, sf, "documents")).select("doc_id", F.lower("text").alias("text"))
    return lm.keyword_scores(d, views.keywords(spark, sf), "doc_id")


_NBEST = "select label as utt, 't' || (vec_id % 17) as text, (vec_id % 5 + 1)::bigint as n_tokens, round(-10 * (1 + embedding[1]::double), 6) as score from embeddings"


def _nbest(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select(F.col("label").alias("utt"), F.concat(F.lit("t"), (F.col("vec_id") % 17).cast("string")).alias("text"), (F.col("vec_id") % 5 + 1).alias("n_tokens"), F.round(-10 * (1 + F.get(e, F.lit(0))), 6).alias("score"))


@query(f"select utt, text, round(m + ln(sum(exp(score - m))), 6) as score from (select *, max(score) over (partition by utt, text) as m from ({_NBEST})) group by utt, text, m")
def nbest_merge(spark: SparkSession, sf: str) -> DataFrame:
    return lm.merged_hypotheses(_nbest(spark, sf))


@query(f"select utt, rank, text, score from (select *, row_number() over (partition by utt order by score desc, text, n_tokens) as rank from (select *, max(score / n_tokens) over (partition by utt) as b from ({_NBEST})) where score / n_tokens >= b - 1.5) where rank <= 8")
def nbest_prune(spark: SparkSession, sf: str) -> DataFrame:
    return lm.pruned(_nbest(spark, sf), 1.5, 8).select("utt", F.col("rank").cast("long").alias("rank"), "text", "score")


@query("""with t as (select conv_id as utt, list_filter(string_split(text, ''), lambda x: x <> '') as k from conversations), e as (select utt, min(k) as a, max(k) as z from t group by utt),
    n as (select utt, a, len(list_filter(range(1, least(len(a), len(z)) + 1), lambda i: a[1:i] = z[1:i])) as n_prefix from e) select utt, n_prefix, a[1:n_prefix] as prefix from n""")
def nbest_prefix(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "conversations").select(F.col("conv_id").alias("utt"), fusion.characters(F.col("text")).alias("tokens"))
    return lm.common_prefix(d)


# signals


@query(f"select dim, count(*) as n, round(avg(x), 8) as mean, round(var_pop(x), 8) as var from ({VALUES}) group by dim")
def feature_stats(spark: SparkSession, sf: str) -> DataFrame:
    return signal.feature_stats(views.frames(spark, sf))


@query(f"with v as ({VALUES}), s as (select dim, round(avg(x), 8) as mean, round(var_pop(x), 8) as var from v group by dim) select vec_id as frame, v.dim, round((x - mean) / sqrt(var), 6) as value from v join s on v.dim = s.dim")
def feature_norm(spark: SparkSession, sf: str) -> DataFrame:
    f = views.frames(spark, sf)
    return signal.normalised(f, signal.feature_stats(f)).select("frame", "dim", "value")


@query(f"select utt, dim, frame, v0, v1, v2 from (select label as utt, dim, vec_id as frame, x as v0, coalesce(lead(x, 1) over w, 0) as v1, coalesce(lead(x, 2) over w, 0) as v2 from ({VALUES}) window w as (partition by label, dim order by vec_id)) where frame % 2 = 0")
def frame_stack(spark: SparkSession, sf: str) -> DataFrame:
    return segments.stacked(views.frames(spark, sf).select("utt", "frame", F.posexplode("features").alias("dim", "value")), 3, 2, by=("utt", "dim"))


@query(f"""with v as ({VALUES}), s as (select dim, round(avg(x), 8) as mean, round(var_pop(x), 8) as var from v group by dim), u as (select label, dim, round(avg(x), 8) as mean, round(var_pop(x), 8) as var from v group by label, dim)
    select v.label as utt, vec_id as frame, v.dim, round(0.3 * (x - s.mean) / sqrt(s.var) + 0.7 * (x - u.mean) / case when u.var > 0 then sqrt(u.var) else 1.0::double end, 6) as value from v join s on v.dim = s.dim join u on u.dim = v.dim and u.label = v.label""")
def blended_norm(spark: SparkSession, sf: str) -> DataFrame:
    f = views.frames(spark, sf)
    return signal.blended(f, signal.feature_stats(f), 0.3)


@query()
def spec_mask(spark: SparkSession, sf: str) -> DataFrame:
    f = views.frames(spark, sf).groupBy("utt", F.expr("frame div 50").alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "features"))), lambda r: r["features"]).alias("x"))
    masked = f.withColumn("y", signal.spec_masked(F.col("x"), F.concat_ws("|", F.col("utt").cast("string"), F.col("part").cast("string")), (2, 0, 8), (0.1, 0, 0.2)))
    zero = F.aggregate(F.flatten("y"), F.lit(0), lambda a, v: a + (v == 0).cast("int"))
    return masked.select("utt", "part", F.size(F.flatten("y")).alias("n"), zero.alias("n_masked"))


@query("""with e as (select vec_id, list_transform(embedding, lambda x: x::double) as s from embeddings), p as (select a.vec_id, a.s[1:48] as s, b.s[1 + floor(16 * ((a.vec_id % 5) / 5.0::double))::int:48 + floor(16 * ((a.vec_id % 5) / 5.0::double))::int] as n from e a join e b on b.vec_id = (a.vec_id + 1) % (select count(*) from e)),
    g as (select vec_id, s, n, list_sum(list_transform(s, lambda x: x * x)) / len(s) as ps, list_sum(list_transform(n, lambda x: x * x)) / len(n) as pn from p), m as (select *, list_transform(range(1, len(s) + 1), lambda i: s[i] + sqrt(ps / (pn * pow(10.0::double, 0.5::double))) * n[i]) as x from g)
    select vec_id, round(list_sum(x) * sqrt(ps / (list_sum(list_transform(x, lambda v: v * v)) / len(x))), 5) as total from m""")
def noise_mix(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("s"))
    n = e.agg(F.count("*").alias("n"))
    noise = e.join(F.broadcast(n)).select(F.expr("(vec_id + n - 1) % n").alias("vec_id"), F.col("s").alias("noise"))
    mixed = e.join(noise, "vec_id").select("vec_id", signal.noise_mixed(F.slice("s", 1, 48), F.col("noise"), F.lit(5.0), (F.col("vec_id") % 5) / 5.0).alias("x"))
    return mixed.select("vec_id", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


@query("""with p as (select a.vec_id, list_transform(a.embedding, lambda x: x::double) as s, list_transform(b.embedding, lambda x: x::double) as n from embeddings a join embeddings b on b.vec_id = (a.vec_id + 1) % (select count(*) from embeddings)),
    g as (select vec_id, s, n, list_sum(list_transform(s, lambda x: x * x)) / len(s) as ps, list_sum(list_transform(n, lambda x: x * x)) / len(n) as pn from p), m as (select *, list_transform(range(1, len(s) + 1), lambda i: s[i] + sqrt(ps / (pn * pow(10.0::double, 1.0::double))) * n[i]) as x from g)
    select vec_id, round(x[1] * sqrt(ps / (list_sum(list_transform(x, lambda v: v * v)) / len(x))), 5) as first, round(list_sum(x) * sqrt(ps / (list_sum(list_transform(x, lambda v: v * v)) / len(x))), 5) as total from m""")
def snr_mix(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("s"))
    count = e.agg(F.count("*").alias("c"))
    noise = e.join(F.broadcast(count)).select(F.expr("(vec_id + c - 1) % c").alias("vec_id"), F.col("s").alias("n"))  # the last one with the first
    mixed = e.join(noise, "vec_id").select("vec_id", signal.snr_mix(F.col("s"), F.col("n"), F.lit(10.0)).alias("x"))
    return mixed.select("vec_id", F.round(F.get("x", F.lit(0)), 5).alias("first"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


@query("""with e as (select vec_id // 16 as batch_no, vec_id as pos, list_transform(embedding, lambda x: x::double) as s from embeddings), b as (select *, coalesce(lead(s) over w, first_value(s) over w) as n, count(*) over (partition by batch_no) as k from e window w as (partition by batch_no order by pos)),
    g as (select *, list_sum(list_transform(s, lambda x: x * x)) / len(s) as ps, list_sum(list_transform(n, lambda x: x * x)) / len(n) as pn from b where k > 1), m as (select *, list_transform(range(1, len(s) + 1), lambda i: s[i] + sqrt(ps / (pn * pow(10.0::double, 1.5::double))) * n[i]) as x from g)
    select batch_no, pos, round(x[1] * sqrt(ps / (list_sum(list_transform(x, lambda v: v * v)) / len(x))), 5) as first from m""")
def babble_mix(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "embeddings").select(F.expr("vec_id div 16").alias("batch_no"), F.col("vec_id").alias("pos"), F.col("embedding").cast("array<double>").alias("signal"))
    return signal.babble(s, 16, 15.0).select("batch_no", "pos", F.round(F.get("mixed", F.lit(0)), 5).alias("first"))


@query(f"""with v as (select vec_id as id, dim as pos, x, dim // 16 as p, dim % 4 as l from ({VALUES})), k as (select id, pos, x, row_number() over (partition by id, p, l order by x desc, pos) = 1 as top from v)
    select id, pos, case when top then x else min(case when top then x end) over (partition by id) end as value from k""")
def fuzzy_topk(spark: SparkSession, sf: str) -> DataFrame:
    return signal.fuzzy_top(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("values")), 4, 16)


@query(f"select label, dim, round(avg(x), 6) as x from ({VALUES}) group by all")
def snapshot_average(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return signal.snapshot_average(d, "label", "v").select("label", F.posexplode("v").alias("dim", "x")).select("label", "dim", F.round("x", 6).alias("x"))


# reports


@query("select key, k // 100 as interval, round(avg(value), 8) as mean, max(value) as max, min(value) as min from (select event_type as key, value, row_number() over (partition by event_type order by event_id) - 1 as k from events) group by all having count(*) = 100")
def metric_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return report.intervals(table(spark, sf, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("step"), "value"), 100)


@query("select event_type, n, round(s, 6) as seconds, round(case when s > 0 then n / s end, 8) as per_second from (select event_type, count(*) as n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::double as s from events group by event_type)")
def throughput(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return report.throughput(e, ["event_type"])


@query("select event_type, param, rate from (select event_type, user_id % 50 as param, value as rate, row_number() over (partition by event_type order by value, event_id) as r from events) where r = 1")
def best_of_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return report.best_of(table(spark, sf, "events").select("event_type", F.expr("user_id % 50").alias("param"), F.col("value").alias("rate"), F.col("event_id").alias("order")), ["event_type"])


@query("""with m as (select lang as dataset, count(*)::double as n, avg(n_chars) as mean, max(n_chars)::double as longest from documents group by lang), l as (unpivot m on n, mean, longest into name metric value value)
    select metric, round(max(case when dataset = 'de' then value end), 4) as de, round(max(case when dataset = 'en' then value end), 4) as en, round(max(case when dataset = 'es' then value end), 4) as es, round(max(case when dataset = 'fr' then value end), 4) as fr from l group by metric""")
def report_pivot(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "documents").groupBy(F.col("lang").alias("dataset")).agg(F.count("*").cast("double").alias("n"), F.avg("n_chars").alias("mean"), F.max("n_chars").cast("double").alias("longest"))
    return report.crosstab(m, ["n", "mean", "longest"], ["de", "en", "es", "fr"])


_METRICS = ", ".join(f"('{m}')" for m in report.METRICS)


@query(f"""with v as (select lang, count(*)::double as words, avg(n_chars) as latency_mean from documents group by lang), l as (unpivot v on words, latency_mean into name metric value value),
    w as (select metric, max(case when lang = 'de' then round(value, 4) end) as de, max(case when lang = 'en' then round(value, 4) end) as en from l group by metric)
    select m.metric, coalesce(de, case when m.metric like '%share' then 0 else 'nan'::double end) as de, coalesce(en, case when m.metric like '%share' then 0 else 'nan'::double end) as en from (values {_METRICS}) m(metric) left join w using (metric)""")
def validation_report(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "documents").groupBy(F.col("lang").alias("dataset")).agg(F.count("*").cast("double").alias("words"), F.avg("n_chars").alias("latency_mean"))
    return report.validation_report(m.unpivot(["dataset"], ["words", "latency_mean"], "metric", "value"), ["de", "en"])


# tokens, joins and sinks


@query()
def subword_tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = spread(table(spark, sf, "documents")).select("doc_id", views.split_words(F.lower("text")).alias("words"))
    return tokens.tokenised(d, subword_vocabulary(spark, sf), "doc_id").select("doc_id", F.size("ids").alias("n_tokens"), F.xxhash64("ids").alias("fingerprint"))


@query(f"""with w as (select doc_id, lower(text) as t from documents) select doc_id, md5(array_to_string({WORDS.format(c='t')}, '')) as decoded from w where len({WORDS.format(c='t')}) > 0""")
def subword_samples(spark: SparkSession, sf: str) -> DataFrame:
    # whatever splits are drawn, their pieces give the words again
    d = spread(table(spark, sf, "documents")).select("doc_id", views.split_words(F.lower("text")).alias("words"))
    v = subword_vocabulary(spark, sf)
    ids = tokens.sampled(d, v, "doc_id", share=0.25)
    return tokens.decoded(ids, v, "doc_id").select("doc_id", F.md5("text").alias("decoded"))


@query()
def oov_audit(spark: SparkSession, sf: str) -> DataFrame:
    # the vocabulary covers documents; conversations may hold characters that it does not
    d = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("utt"), views.split_words(F.lower("text")).alias("words"))
    ids = tokens.tokenised(d, subword_vocabulary(spark, sf), "utt")
    return ids.agg(F.count("*").alias("n"), F.count_if(F.array_contains("ids", 0)).alias("unknown"))


@query(f"select file, line from (select file, seq, file || ' 1 ' || format('{{:.3f}}', start) || ' 0.250 ' || word as line from ({CTM}))")
def ctm_lines(spark: SparkSession, sf: str) -> DataFrame:
    c = views.ref_ctm(spark, sf)
    return writers.ctm_lines(c.withColumn("file", F.col("file").cast("string"))).select(F.element_at(F.split("value", " "), 1).cast("long").alias("file"), F.col("value").alias("line"))


@query("select 'hub/' || (i // 100) || '/' || ((i // 10) % 10) || '/' || i || '.flac' as fname, doc_id, i // 250 as chunk from (select doc_id, row_number() over (order by doc_id) - 1 as i from documents)")
def hub_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return readers.hub_manifest(table(spark, sf, "documents"), "text", "hub", 10, 10, 250, ["doc_id"]).select("fname", "doc_id", "chunk")


@query(f"select count(*) as total_utts, count(*) filter (where doc_id % 4 <> 0) as processed_utts, sum(case when doc_id % 4 <> 0 then len({WORDS.format(c='text')}) else 0 end)::bigint as processed_words from documents")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("utt"), views.split_words(F.col("text")).alias("words"))
    return curate.coverage(d, d.where("utt % 4 <> 0"), "utt", "words")


@query("select user_id, count(*) as n, count(*) filter (where event_type = 'purchase') as processed, max_by(event_type, event_id) as last from events group by user_id")
def event_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("processed"), F.max_by("event_type", "event_id").alias("last"))


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def pending_work(spark: SparkSession, sf: str) -> DataFrame:
    return curate.pending(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@query(f"select n.utt, n.text, round(n.score + 0.25 * coalesce(e.score, 0), 8) as score from ({_NBEST}) n left join (select utt, text, max(score) as score from ({_NBEST}) group by utt, text) e using (utt, text)")
def nbest_rescore(spark: SparkSession, sf: str) -> DataFrame:
    n = _nbest(spark, sf)
    return lm.rescored(n, n.groupBy("utt", "text").agg(F.max("score").alias("score")), 0.25).select("utt", "text", "score")


@query()
def noise_assignment(spark: SparkSession, sf: str) -> DataFrame:
    utts = table(spark, sf, "documents").select(F.col("doc_id").alias("utt"))
    noises = indexed(table(spark, sf, "embeddings").select("vec_id"), ["vec_id"], "noise_id")
    return signal.noise_assignment(utts, noises, 3, 0.0, 30.0).select("utt", "noise_id", F.round("snr", 6).alias("snr"), F.round("start", 6).alias("start"))


@query(f"""with r as (select * from ({RESPONSES}) where kind in ('partial', 'final')), g as (select session, coalesce(string_agg(text, '' order by ts, seq) filter (where kind = 'final'), '') as finals, max((ts, seq)) filter (where kind = 'final') as last, max((ts, seq)) filter (where kind = 'partial') as p, arg_max(text, (ts, seq)) filter (where kind = 'partial') as open from r group by session)
    select session, finals, finals || case when p is not null and (last is null or p > last) then coalesce(open, '') else '' end as shown from g""")
def display_state(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.display(views.responses(spark, sf))
