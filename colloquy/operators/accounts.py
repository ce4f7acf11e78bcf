"""Accounts of one person on different platforms, linked by how they write, when, and about what.

Four signals give the confidence of a pair: the cosine of the accounts' mean post embeddings (0.40), of
their histograms over the hours of a week (0.25), the overlap of their topics (0.20), and the cosine of
their character n-grams by TF-IDF (0.15). From 0.85 on a pair is linked, and links give persons.

Pairs are not formed all with all. Each account enters the inverted lists of its rarest n-grams, those
that at most `RARE_ACCOUNTS` accounts use; two accounts of different platforms that meet in `MEETINGS` of
them are candidates. So lists are short by definition, and each account meets a bounded number of others,
however many there are. A pair that shares no rare n-grams isn't looked at. Texts are dealt by account once,
and what is counted of them is stored; n-grams are not shuffled row by row again. For the cosines an account's
n-grams are packed into a few compressed pieces, which a pair brings together.

Null and blank posts add nothing to n-grams, but count for time, posts without a time for all but that; an account without vectors has style 0, one
without topics overlap 0. Accounts of null are ignored. Repeated posts count as often as they are there.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model
from ..catalog import query
from ..functions import values
from ..functions.text import with_relevance
from ..plans.components import components
from ..sources.shared import checkpointed, written
from ..sources.tables import embeddings, posts
from .correlation import SALT, pseudo_id

# Weights of the four signals.
STYLE, TEMPORAL, TOPIC, VOCABULARY = 0.40, 0.25, 0.20, 0.15
#: Letters of an n-gram; accounts that a rare one has at most; rarest ones that an account is listed under; lists that a pair must share.
GRAM, RARE_ACCOUNTS, RAREST, MEETINGS = 4, 20, 40, 2


#: Characters that are counted at once; n-grams, the most frequent ones, that are joined by broadcast (the others are by shuffle).
CHUNK, COMMON = 1 << 20, 200_000


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text without those over the ends of its lines, and how often each is there."""
    signs = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if len(signs) < GRAM:
        return np.empty(0, object), np.empty(0, np.int64)
    if signs.max() >= 1 << 16 or signs.min() == 0:  # four signs don't fit into a number, or numpy would cut them
        found = Counter(line[i : i + GRAM] for line in text.split("\n") for i in range(len(line) - GRAM + 1))
        return np.array(list(found), object), np.fromiter(found.values(), np.int64, len(found))
    n = len(signs) - GRAM + 1
    code, whole = np.zeros(n, np.uint64), np.ones(n, bool)
    for i in range(GRAM):
        code = code << np.uint64(16) | signs[i : i + n]
        whole &= signs[i : i + n] != ord("\n")
    code, times = np.unique(code[whole], return_counts=True)
    parts = np.stack([(code >> np.uint64(16 * (GRAM - 1 - i))) & np.uint64(0xFFFF) for i in range(GRAM)], 1).astype("<u4")
    return np.ascontiguousarray(parts).view(f"<U{GRAM}").ravel().astype(object), times


def _count_accounts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """account, gram and tf out of (account, lines), which come in order of accounts."""
    account, texts, size, total = None, [], 0, None

    def count() -> None:
        nonlocal texts, size, total
        found = _counted("\n".join(texts))
        texts, size = [], 0
        if total is None:
            total = found
        else:
            both = Counter(dict(zip(*total, strict=True)))
            both.update(dict(zip(*found, strict=True)))
            total = np.array(list(both), object), np.fromiter(both.values(), np.int64, len(both))

    def rows() -> pa.RecordBatch:
        count()
        return pa.RecordBatch.from_arrays([pa.array([account] * len(total[0]), pa.string()), pa.array(total[0], pa.string()), pa.array(total[1], pa.int64())], ["account", "gram", "tf"])

    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if name != account:
                if account is not None:
                    yield rows()
                account, total = name, None
            texts.append(text)
            size += len(text)
            if size >= CHUNK:
                count()
    if account is not None:
        yield rows()


def vocabulary(rows: DataFrame) -> DataFrame:
    """account, gram, id (of the gram), tf, df (accounts that have it), n (accounts with grams) and weight (TF-IDF)."""
    lines = F.concat(F.lit("_"), F.regexp_replace(F.lower("content"), "[ \t\n\r]+", "_\n_"), F.lit("_"))
    texts = rows.where("content is not null").select("account", lines.alias("lines")).repartition("account").sortWithinPartitions("account")
    tf = written(texts.mapInArrow(_count_accounts, "account string, gram string, tf long"))
    # in order of df, so that neighbouring ids have df in common
    df = written(tf.groupBy("gram").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "gram").withColumn("id", F.monotonically_increasing_id()))
    n = tf.select("account").distinct().count()
    known = tf.join(F.broadcast(df.orderBy("id").limit(COMMON)), "gram", "left")
    others = known.where("id is null").select("account", "gram", "tf").join(df, "gram")
    weight = (1 + F.log(F.col("tf").cast("double"))) * F.log(F.lit(float(n)) / F.col("df"))
    return known.where("id is not null").unionByName(others).select("account", "gram", "id", "tf", "df", F.lit(n).cast("long").alias("n"), weight.alias("weight"))


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """account and piece (compressed ids, tf and df) of the n-grams that come one after another."""
    for batch in batches:
        out = []
        for account, own in batch.sort_values(["account", "id"]).groupby("account", sort=False):
            steps = [np.diff(own[c].to_numpy(np.int64), prepend=0) for c in ("id", "df")]
            out.append((account, zlib.compress(np.stack([*steps, own["tf"].to_numpy(np.int64)]).tobytes(), 6)))
        yield pd.DataFrame(out, columns=["account", "piece"])


def packed(grams: DataFrame) -> DataFrame:
    """account and pieces, which hold all its n-grams."""
    pieces = grams.select("account", "id", "df", "tf").mapInPandas(_pack, "account string, piece binary")
    return pieces.groupBy("account").agg(F.collect_list("piece").alias("pieces"))


def _weights(pieces: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and weights at unit length."""
    ids, df, tf = np.concatenate([np.stack([t[0].cumsum(), t[1].cumsum(), t[2]]) for t in (np.frombuffer(zlib.decompress(p), np.int64).reshape(3, -1) for p in pieces)], 1)
    order = np.argsort(ids)
    w = ((1 + np.log(tf)) * np.log(n / df))[order]
    return ids[order], w / (np.sqrt((w * w).sum()) or 1.0)


def shared_vocabulary(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """a, b and vocabulary, the cosine of their n-grams."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for one, other, n in zip(batch["pieces_a"], batch["pieces_b"], batch["n"], strict=True):
                (x, v), (y, w) = _weights(one, n), _weights(other, n)
                _, i, j = np.intersect1d(x, y, True, True)
                out.append(float(v[i] @ w[j]))
            yield batch[["a", "b"]].assign(vocabulary=np.array(out, np.float64))

    some = grams.select("n").limit(1)
    own = _both(pairs, written(packed(grams)), "pieces").where("pieces_a is not null and pieces_b is not null").crossJoin(F.broadcast(some))
    return own.mapInPandas(run, "a string, b string, vocabulary double")


def candidates(grams: DataFrame, platforms: DataFrame) -> DataFrame:
    """Pairs a < b of accounts on different platforms that meet in the lists of rare n-grams."""
    place = F.row_number().over(Window.partitionBy("account").orderBy("df", "gram"))
    rare = grams.where((F.col("df") > 1) & (F.col("df") <= RARE_ACCOUNTS)).select("account", "gram", "df").withColumn("place", place).where(F.col("place") <= RAREST)
    listed = checkpointed(rare.select("account", "gram").join(platforms, "account"))
    left, right = (listed.select("gram", F.col("account").alias(x), F.col("platform").alias(f"{x}_platform")) for x in "ab")
    met = left.join(right, "gram").where("a < b and a_platform <> b_platform")
    return met.groupBy("a", "b").agg(F.count("*").alias("meetings")).where(F.col("meetings") >= MEETINGS).select("a", "b")


def _both(pairs: DataFrame, signals: DataFrame, *names: str) -> DataFrame:
    for x in "ab":
        pairs = pairs.join(signals.select(F.col("account").alias(x), *[F.col(n).alias(f"{n}_{x}") for n in names]), x, "left")
    return pairs


def pair_confidence(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """a, b, style, temporal, topic, vocabulary, confidence and linked of the candidate pairs.

    rows: account, platform, content, collected_at, topics (array); vectors: account, embedding (several of an account are averaged).
    """
    rows = rows.where("account is not null")
    grams = vocabulary(rows)
    pairs = checkpointed(candidates(grams, rows.groupBy("account").agg(F.min("platform").alias("platform"))))

    part = vectors.where("embedding is not null").select("account", F.posexplode("embedding").alias("i", "x")).groupBy("account", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    style = part.groupBy("account").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("style"))
    hour = ((F.dayofweek("collected_at") - 1) * 24 + F.hour("collected_at")).alias("hour")
    hours = rows.where("collected_at is not null").groupBy("account", hour).agg(F.count("*").alias("n")).groupBy("account").agg(F.map_from_entries(F.collect_list(F.struct("hour", "n"))).alias("hours"))
    topics = rows.select("account", F.explode("topics").alias("topic")).groupBy("account").agg(F.collect_set("topic").alias("topics"))

    own = _both(_both(_both(pairs, style, "style"), hours, "hours"), topics, "topics")
    week = F.sequence(F.lit(0), F.lit(167))

    def over_week(hours: Column) -> Column:
        return F.transform(week, lambda h: F.coalesce(F.try_element_at(hours, h), F.lit(0)).cast("double"))

    none = F.array().cast("array<string>")
    ta, tb = F.coalesce("topics_a", none), F.coalesce("topics_b", none)
    own = own.select(
        "a", "b", F.coalesce(values.cosine(F.col("style_a"), F.col("style_b")), F.lit(0.0)).alias("style"),
        values.cosine(over_week(F.col("hours_a")), over_week(F.col("hours_b"))).alias("temporal"),
        values.ratio(F.size(F.array_intersect(ta, tb)).cast("double"), F.size(F.array_union(ta, tb)).cast("double")).alias("topic"),
    )
    found = own.join(shared_vocabulary(pairs, grams), ["a", "b"], "left").withColumn("vocabulary", F.coalesce("vocabulary", F.lit(0.0)))
    confidence = STYLE * F.col("style") + TEMPORAL * F.col("temporal") + TOPIC * F.col("topic") + VOCABULARY * F.col("vocabulary")
    return found.withColumn("confidence", F.round(confidence, 6)).withColumn("linked", F.col("confidence") >= model.GATE_CONFIDENCE)


def persons(accounts: DataFrame, pairs: DataFrame, salt: str = SALT) -> DataFrame:
    """account, person (the first of the accounts that links join) and pseudo_id; an account without link is a person."""
    joined = components(pairs.where("linked").select("a", "b"))
    person = F.coalesce("component", "account")
    return accounts.select("account").where("account is not null").distinct().join(joined.withColumnRenamed("node", "account"), "account", "left").select("account", person.alias("person"), pseudo_id(F.concat(person, F.lit(salt))).alias("pseudo_id"))


def derived_accounts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Posts with an account (a source, and a block of two hundred ids), and the vectors of those that have one."""
    account = F.concat_ws("/", "source_name", F.floor(F.col("post_id") / 200).cast("string"))
    rows = with_relevance(posts(spark, sf_dir)).where("source_name is not null").select("post_id", account.alias("account"), F.col("source_name").alias("platform"), "content", "collected_at", F.col("matched_keywords").alias("topics"))
    return rows, rows.select("post_id", "account").join(embeddings(spark, sf_dir), "post_id").select("account", "embedding")


_OWN = "select post_id, source_name || '/' || (post_id // 200) as account, source_name as platform, low, collected_at, matched_keywords as topics from relevance where source_name is not null"
_PAIRS = f"""own as materialized ({_OWN}
), words as (
    select account, word, count(*) as times from (select account, unnest(string_split_regex(low, '[ \\t\\n\\r]+')) as word from own) where word <> '' group by all
), tf as materialized (
    select account, gram, sum(times) as tf from (select account, times, unnest(list_transform(range(1, len(word) + 2 - {GRAM - 2}), lambda i: substr('_' || word || '_', i, {GRAM}))) as gram from words where len(word) + 2 >= {GRAM}) group by all
), weighted as materialized (
    select account, gram, df, (1 + ln(tf::double)) * ln((select count(distinct account) from tf)::double / df) as weight from tf join (select gram, count(*) as df from tf group by gram) using (gram)
), grams as materialized (
    select w.*, weight / size as w from weighted w join (select account, sqrt(sum(weight * weight)) as size from weighted group by account) using (account)
), rare as materialized (
    select account, gram, split_part(account, '/', 1) as platform from weighted where df between 2 and {RARE_ACCOUNTS} qualify row_number() over (partition by account order by df, gram) <= {RAREST}
), pairs as materialized (
    select x.account as a, y.account as b from rare x join rare y on x.gram = y.gram and x.account < y.account and x.platform <> y.platform group by all having count(*) >= {MEETINGS}
), styles as (
    select account, list(x order by i) as v from (select account, i, avg(e[i]::double) as x from (select account, embedding as e, unnest(range(1, len(embedding) + 1)) as i from own join embeddings on vec_id = post_id) group by all) group by account
), hours as (
    select account, list(n order by h) as v from (select a.account, h, coalesce(n, 0)::double as n from (select distinct account from own) a cross join range(168) t(h)
        left join (select account, dayofweek(collected_at) * 24 + hour(collected_at) as h, count(*) as n from own group by all) using (account, h)) group by account
), topics as (
    select account, list_distinct(flatten(list(topics))) as t from own group by account
), shared as (
    select a, b, sum(x.w * y.w) as vocabulary from pairs join grams x on x.account = a join grams y on y.account = b and y.gram = x.gram group by all
), signals as materialized (
    select p.a, p.b, coalesce(list_cosine_similarity(sa.v, sb.v), 0) as style, list_cosine_similarity(ha.v, hb.v) as temporal,
        case when len(list_distinct(ta.t || tb.t)) = 0 then 0 else len(list_intersect(ta.t, tb.t))::double / len(list_distinct(ta.t || tb.t)) end as topic, coalesce(vocabulary, 0) as vocabulary
    from pairs p left join styles sa on sa.account = p.a left join styles sb on sb.account = p.b join hours ha on ha.account = p.a join hours hb on hb.account = p.b
    join topics ta on ta.account = p.a join topics tb on tb.account = p.b left join shared s on s.a = p.a and s.b = p.b
), confident as materialized (
    select *, round({STYLE}::double * style + {TEMPORAL}::double * temporal + {TOPIC}::double * topic + {VOCABULARY}::double * vocabulary, 6) as confidence from signals
)"""


def _after(ctes: str, tail: str) -> str:
    """SQL behind the derived tables with tables of its own: the catalogue puts `with ...` before it."""
    return f", {ctes}\n{tail}"


@query("account_links", _after(_PAIRS, f"select a, b, round(style, 6) as style, round(temporal, 6) as temporal, round(topic, 6) as topic, round(vocabulary, 6) as vocabulary, confidence, confidence >= {model.GATE_CONFIDENCE} as linked from confident"))
def account_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidate pairs of accounts with their four signals."""
    found = pair_confidence(*derived_accounts(spark, sf_dir))
    return found.select("a", "b", *[F.round(c, 6).alias(c) for c in ("style", "temporal", "topic", "vocabulary")], "confidence", "linked")


@query("account_persons", _after(_PAIRS, f"""select account, min(person) as person from (
    with recursive reached as (select distinct account, account as person from own union select r.account, e.b from reached r join
        (select a, b from confident where confidence >= {model.GATE_CONFIDENCE} union all select b, a from confident where confidence >= {model.GATE_CONFIDENCE}) e on e.a = r.person)
    select * from reached) group by account"""))  # fmt: skip
def account_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons behind the accounts."""
    rows, vectors = derived_accounts(spark, sf_dir)
    return persons(rows, pair_confidence(rows, vectors)).select("account", "person")
