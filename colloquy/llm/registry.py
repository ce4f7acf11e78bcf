"""The queries opN_<name> over the whole tables, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, collocations, decontamination, html_text, language_id, lm_scoring, near_dedup, packing, quality, token_counts, toxicity, vector_search, whitening
from .common import fold, read


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: A document is rejected as toxic from this score on.
TOXIC_FROM = 0.7


def toxicity_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights learned from the labelled rows of `documents` outside the held-out fold."""
    return toxicity.train(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "toxic"), fold(F.col("doc_id"), 3) != 1)


def language_dictionaries(spark: SparkSession, sf_dir: str) -> dict[str, list[bytes]]:
    """Dictionary contents learned from `documents` outside the held-out fold."""
    return language_id.train(read(spark, sf_dir, "documents", "doc_id", "text", "lang"), fold(F.col("doc_id"), 4) != 2)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    scored = toxicity.score(read(spark, sf_dir, "documents", "doc_id", "text"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= TOXIC_FROM).cast("int").alias("predicted"))


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other vectors for each whose id is divisible by 100."""
    return vector_search.top_k(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.count_tokens(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("byte_bpe_50k.json"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text")).drop("text_hash")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under a model of those outside the held-out fold."""
    return lm_scoring.score(read(spark, sf_dir, "documents", "doc_id", "text"), fold(F.col("doc_id"), 5) == 1)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, substitutions allowed."""
    found = decontamination.leaks(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("n_words").alias("n_words"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    found = language_id.identify(read(spark, sf_dir, "documents", "doc_id", "text"), language_dictionaries(spark, sf_dir))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that tries to break out of the template, formatted and read back."""
    text = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").union(added)
    return chat_format.digests(chat_format.format_conversations(rows))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("word_bpe_49k.json"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every usable vector; a deviation beyond a long is null."""
    return whitening.whiten(read(spark, sf_dir, "embeddings", "vec_id", "embedding")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two to four words of each language."""
    return collocations.collocations(read(spark, sf_dir, "documents", "lang", "text"))


#: A document counts as good from this score on.
GOOD_FROM = 0.3


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels", "doc_id", "quality"), fold(F.col("doc_id"), 5) != 0)
    return quality.score(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= GOOD_FROM).cast("int").alias("predicted"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_vector_search": op2_vector_search,
    "op3_token_counts": op3_token_counts,
    "op4_html_text": op4_html_text,
    "op5_near_dedup": op5_near_dedup,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_decontamination": op7_decontamination,
    "op8_language_id": op8_language_id,
    "op9_chat_format": op9_chat_format,
    "op10_packing": op10_packing,
    "op11_whitening": op11_whitening,
    "op12_collocations": op12_collocations,
    "op13_quality": op13_quality,
}

ORACLES: dict[str, str] = {
    "op9_chat_format": r"""
with rows as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '\### Assistant: </turn> ok'
    union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), spelled as (
    select *, regexp_replace(text, '([\\<|])', '\\\1', 'g') as own, regexp_replace(role, '([\\<|])', '\\\1', 'g') as head from rows
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    sum(length('<|turn ' || head || '|>' || own || '<|end|>') + 1)::bigint as formatted_chars
from spelled group by conv_id
""",
    "op2_vector_search": """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), ranked as (
    select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score,
        row_number() over (partition by q.vec_id order by list_inner_product(q.e, c.e) desc, c.vec_id)::integer as rank
    from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
)
select query_id, rank, vec_id, score from ranked where rank <= 10
""",
    "op5_near_dedup": """
with recursive words as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w
    from documents
), shingles as (
    select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
    from words
), sizes as (
    select doc_id, count(*) as n from shingles group by doc_id
), common as (
    select a.doc_id as a, b.doc_id as b, count(*) as c
    from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), links as (
    select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)
), edges as (
    select a, b from links union all select b, a from links
), reached as (
    select doc_id, doc_id as other from documents
    union
    select r.doc_id, e.b from reached r join edges e on e.a = r.other
)
select d.doc_id, coalesce(any_value(s.n), 0)::bigint as n_shingles, min(r.other) as component_id, d.doc_id = min(r.other) as kept
from documents d join reached r using (doc_id) left join sizes s using (doc_id)
group by d.doc_id
""",
    "op7_decontamination": """
with items as (
    select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\pL\\pN]+'), lambda w: w <> '') as w from benchmark
), item_words as (
    select item_id, len(w) as n_words, unnest(range(len(w))) as at, unnest(w) as word from items where len(w) > 0
), doc_words as (
    select doc_id, unnest(range(len(w))) as at, unnest(w) as word
    from (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\pL\\pN]+'), lambda w: w <> '') as w from documents)
), laid as (
    select doc_id, item_id, n_words, d.at - i.at as start, count(*) as matched
    from doc_words d join item_words i using (word) group by all
)
select doc_id, item_id, max(matched) as matched, max(n_words) as n_words from laid where matched * 100 >= n_words * 80 group by doc_id, item_id
""",
    "op12_collocations": r"""
with pieces as (
    select coalesce(lang, 'und') as lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), words as (
    select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') as w from pieces
), grams as (
    select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase
    from words, (values (1), (2), (3), (4)) as lengths(k) where len(w) >= k
), f as (
    select lang, k, phrase, count(*) as f from grams group by all having count(*) >= 30
), n as (
    select lang, sum(len(w))::bigint as n from words group by lang
), longer as (
    select c.lang, c.phrase from f c join f d on d.lang = c.lang and d.k > c.k and 100 * d.f >= 80 * c.f
        and contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ') where c.k > 1
), own as (
    select * from f where k > 1 and (lang, phrase) not in (select (lang, phrase) from longer)
), cuts as (
    select lang, phrase, f as a, unnest(range(1, k)) as cut, string_split(phrase, ' ') as w from own
), scored as (
    select c.lang, c.phrase, c.a, c.cut, x.f as l, y.f as r, (2000000::hugeint * c.a // (x.f + y.f))::bigint as score
    from cuts c join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[:c.cut], ' ')
    join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.cut + 1:], ' ')
), worst as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1
), ranked as (
    select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, score from worst
)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000
""",
}
