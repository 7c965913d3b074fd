"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm import (
    bpe,
    conversations,
    decontamination,
    jaccard,
    licences,
    line_dedup,
    nbsvm,
    neighbours,
    packing,
    quality_rules,
    resampling,
    substring,
    toxicity,
)
from citeweave.llm.common import crc_remainder
from citeweave.llm.oracles import CONVERSATIONS_SQL, DECONTAMINATION_SQL, RESAMPLING_SQL

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Known licences that a whole document, or whole lines of it, are equal to."""
    docs, known = _table(spark, folder, "documents"), licences.known_texts(spark)
    whole = licences.scan(docs, known)
    lines = licences.scan(licences.parts(docs), known).where("licence is not null")
    lines = lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.array_join(F.array_sort(F.collect_set("licence")), "|").alias("line_licences"),
    )
    return whole.join(lines, "doc_id", "left").select(
        "doc_id",
        "digest",
        "licence",
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("line_licences", F.lit("")).alias("line_licences"),
    )


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge(
        spark, _table(spark, folder, "documents"), _table(spark, folder, "labels")
    )
    return judged.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, folder, "documents"), tokenizer_path())
    return packing.pack(spark, pieces)


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    held = crc_remainder(F.col("doc_id"), 5) == 0
    scores = toxicity.score(
        spark, _table(spark, folder, "documents"), _table(spark, folder, "labels"), ~held
    )
    return scores.select("doc_id", held.alias("held_out"), "score", "predicted")


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(_table(spark, folder, "documents"), tokenizer_path()))


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.drop_similar_lines(spark, _table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    held = crc_remainder(F.col("doc_id"), 3) == 1
    scores = nbsvm.score(
        spark,
        _table(spark, folder, "documents"),
        _table(spark, folder, "labels"),
        "quality",
        ~held,
    )
    return scores.select("doc_id", held.alias("held_out"), "score", "predicted")


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring.remove_repeats(spark, _table(spark, folder, "documents"))
    return substring.digests(found)


def op9_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search_neighbours(
        spark, _table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0
    )


def op10_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard.similar_documents(spark, _table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.find_contamination(
        spark, _table(spark, folder, "documents"), _table(spark, folder, "benchmark"), window=10
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = resampling.resample(
        spark,
        _table(spark, folder, "documents"),
        _table(spark, folder, "benchmark"),
        percent=10,
        min_words=20,
        buckets=10_000,
        max_words=1,
        seed=2024,
    )
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = conversations.damage(_table(spark, folder, "conversations"))
    return conversations.repair(spark, rows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_license_scan,
        op2_quality_rules,
        op3_best_fit_packing,
        op4_toxicity,
        op5_bpe,
        op6_line_dedup,
        op7_quality_classifier,
        op8_substring_dedup,
        op9_neighbours,
        op10_ngram_jaccard,
        op11_decontamination,
        op12_importance_resampling,
        op13_conversation_repair,
    ]
    return {f.__name__: f for f in own}


# --- SQL ---------------------------------------------------------------------


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(coalesce({text}, ''), {_quoted(licences.COPYRIGHT_LINE)}, chr(10), 'g')"
    out = f"regexp_replace(lower({out}), {_quoted(licences.NOT_IN_WORDS)}, '  ', 'g')"
    out = f"(' ' || {out} || ' ')"
    for word, same in licences.SPELLINGS.items():
        out = f"replace({out}, ' {word} ', ' {same} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def _license_sql() -> str:
    known = ", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in licences.KNOWN.items())
    return f"""
    with given(licence, body) as (values {known}),
    known as (select {_canonical_sql("body")} form, min(licence) licence from given group by 1),
    whole as (select doc_id, {_canonical_sql("text")} form from documents),
    parts as (select doc_id, unnest(string_split(text, chr(10))) line from documents),
    hits as (select doc_id, licence from parts join known on {_canonical_sql("line")} = form
             where trim(line) <> ''),
    lines as (select doc_id, count(*) n_lines,
                     string_agg(distinct licence, '|' order by licence) line_licences
              from hits group by doc_id)
    select w.doc_id, case when w.form <> '' then sha256(w.form) end digest, k.licence,
           coalesce(l.n_lines, 0) n_lines, coalesce(l.line_licences, '') line_licences
    from whole w left join known k on w.form = k.form and w.form <> ''
    left join lines l on l.doc_id = w.doc_id"""


WORDS_SQL = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

# Levels of doubling; no text of the given tables has a longer repeat.
LEVELS = [50 << i for i in range(10)]


def _longer_sql(length: int) -> str:
    """Places at which a window of ``length`` words stands in two classes."""
    half = length // 2
    return f"""
    h{length} as (select r.id, r.s, md5(array_to_string(c.w[r.s:r.s + {length - 1}], ' ')) h
        from r{half} r join r{half} q on q.id = r.id and q.s = r.s + {half} join c on c.id = r.id),
    r{length} as (select id, s from h{length}
        join (select h from h{length} group by h having min(id) < max(id)) using (h)),"""


SUBSTRING_SQL = rf"""
    with d as (select doc_id, {WORDS_SQL} w from documents),
    starts as (select doc_id, w, unnest(range(1, len(w) - 48)) s from d where len(w) >= 50),
    win as (select doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) h from starts),
    least as (select h, min(doc_id) m from win group by h),
    hit as (select distinct win.doc_id, unnest(range(s, s + 50)) i
            from win join least using (h) where m < win.doc_id),
    gone as (select doc_id, list(distinct i) g from hit group by doc_id),
    c as (select min(doc_id) id, w from d group by w),
    h50 as (select doc_id id, s, h from win where doc_id in (select id from c)),
    r50 as (select id, s from h50
        join (select h from h50 group by h having min(id) < max(id)) using (h)),
    {"".join(_longer_sql(n) for n in LEVELS[1:])}
    longest as (select id, max(n) longest from (
        {" union all ".join(f"select id, {n} n from r{n}" for n in LEVELS)}) group by id)
    select d.doc_id, len(d.w)::bigint n_words, coalesce(len(g), 0)::bigint n_removed,
           sha256(array_to_string(case when g is null then d.w else
               list_transform(list_filter(range(1, len(d.w) + 1), lambda i: not list_contains(g, i)),
                              lambda i: d.w[i]) end, ' ')) kept_sha256,
           coalesce(longest, 0)::bigint longest
    from d left join gone using (doc_id) join c on c.w = d.w left join longest on longest.id = c.id"""

JACCARD_SQL = r"""
    with recursive d as (
        select doc_id, list_filter(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
    g as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') || ' ' || least(len(w), 5) s
          from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i
                from d where len(w) > 0)),
    n as (select doc_id, count(*) n from g group by 1),
    pairs as (select a.doc_id x, b.doc_id y, count(*) o from g a join g b
              on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
    links as (select x, y from pairs join n p on p.doc_id = x join n q on q.doc_id = y
              where 100 * o >= 80 * (p.n + q.n - o)),
    both_ways as (select x, y from links union all select y, x from links),
    reach as (select doc_id a, doc_id b from d
              union select a, y from reach join both_ways on b = x)
    select d.doc_id, coalesce(n.n, 0) n_shingles, min(b) component_id
    from d left join n using (doc_id) join reach on a = d.doc_id group by 1, 2"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; brute-force tests stand for the others."""
    return {
        "op1_license_scan": _license_sql(),
        "op8_substring_dedup": SUBSTRING_SQL,
        "op10_ngram_jaccard": JACCARD_SQL,
        "op11_decontamination": DECONTAMINATION_SQL,
        "op12_importance_resampling": RESAMPLING_SQL,
        "op13_conversation_repair": CONVERSATIONS_SQL,
    }
