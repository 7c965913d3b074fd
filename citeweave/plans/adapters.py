"""The given tables seen as works, papers, edges and responses.

``lineitem``/``part``/``orders`` stand for edges and papers, ``documents`` for
works with long texts, ``conversations`` for model responses. Fixed remainders
of the keys put nulls, blanks and bad dates in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeweave.functions.abstracts import bind
from citeweave.session import scratch_dir

# Fixed dictionary: nested, overlapping, inner-word and punctuation entries.
DICTIONARY = [
    "the",
    "that",
    "from",
    "tion",
    "the and",
    "ther",
    "than",
    "of the",
    "attion to",
    "eriner thanea",
    "thanedble the",
    "zzz",
    "c++",
]

# Tasks that documents are dealt out to, for each core.
TASKS_PER_CORE = 4


class Tables:
    """Lazily read tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._read: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    def documents(self) -> DataFrame:
        """Documents where they lie: their files spread them, texts are not moved."""
        return self["documents"]

    def spread(self) -> DataFrame:
        """Documents dealt out by id to several tasks a core.

        The given documents can be one row group, which one task reads. Texts are moved
        before anything is made of them, when they are smallest.
        """
        parts = TASKS_PER_CORE * self.spark.sparkContext.defaultParallelism
        return self["documents"].repartition(parts, "doc_id")

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that is made once per application and then read from scratch.

        Works and texts are made from ``spread`` documents and written where they are made,
        like tables that an ingest has written. So are the papers that arrive in waves.
        """
        if name not in self._read:
            path = scratch_dir(self.spark, name)
            made = make()
            made.write.parquet(path)
            self._read[name] = self.spark.read.schema(made.schema).parquet(path)
        return self._read[name]

    def dictionary(self) -> DataFrame:
        return self.spark.createDataFrame([(c,) for c in DICTIONARY], "concept string")

    def phrase_dictionary(self) -> DataFrame:
        """Every two neighbouring words of the benchmark texts."""
        return self._neighbours(self["benchmark"].select("text"))

    def title_dictionary(self) -> DataFrame:
        """Every two neighbouring words of the documents' first lines: grows with them."""
        return self._neighbours(self.documents().select(_first_line().alias("text")))

    def _neighbours(self, texts: DataFrame) -> DataFrame:
        words = F.filter(F.split(F.lower("text"), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
        lists = texts.select(words.alias("words"))
        following = F.slice("words", 2, F.size("words"))
        pairs = F.zip_with("words", following, lambda a, b: F.concat_ws(" ", a, b))
        pairs = F.slice(pairs, 1, F.greatest(F.size("words") - 1, F.lit(0)))
        return lists.select(F.explode(pairs).alias("concept")).distinct()


_OPEN: dict[tuple[str, str], Tables] = {}


def open_tables(spark: SparkSession, folder: str) -> Tables:
    """The folder's tables, opened once per application like those of a catalog."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _OPEN:
        _OPEN[key] = Tables(spark, folder)
    return _OPEN[key]


def _order_concepts(t: Tables) -> DataFrame:
    lines = t["lineitem"].select("l_orderkey", "l_partkey")
    parts = t["part"].select("p_partkey", F.lower("p_name").alias("concept"))
    joined = lines.join(parts, lines.l_partkey == parts.p_partkey)
    return joined.select("concept", "l_orderkey").distinct()


def order_edges(t: Tables, shard: bool = False) -> DataFrame:
    edges = _order_concepts(t)
    extra = [(F.col("l_orderkey") % 4).alias("shard")] if shard else []
    return edges.select("concept", _paper_id("l_orderkey"), *extra)


def order_papers(t: Tables, shard: bool = False) -> DataFrame:
    matched = (
        _order_concepts(t)
        .groupBy("l_orderkey")
        .agg(F.count(F.lit(1)).cast("int").alias("n"))
    )
    key = F.col("o_orderkey")
    text = "string"
    return (
        t["orders"]
        .join(matched, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            _paper_id("o_orderkey").alias("id"),
            F.lit(None).cast(text).alias("doi"),
            F.when(key % 97 == 0, F.lit(None).cast(text))
            .when(key % 89 == 0, F.lit("   "))
            .otherwise(F.concat(F.lit("Order "), key.cast(text), F.lit(" "), "o_orderpriority"))
            .alias("title"),
            F.when(key % 83 == 0, F.lit(None).cast(text))
            .when(key % 101 == 0, F.lit(""))
            .otherwise(
                F.concat(
                    F.lit("Status "), "o_orderstatus", F.lit(" customer "),
                    F.col("o_custkey").cast(text),
                )
            )
            .alias("abstract"),
            F.when(key % 79 != 0, F.year("o_orderdate")).alias("publication_year"),
            F.when(key % 73 == 0, F.lit("unknown"))
            .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
            .alias("publication_date"),
            F.col("o_orderstatus").alias("type"),
            F.when(key % 71 != 0, F.floor(F.col("o_totalprice") / 1000).cast("int")).alias(
                "cited_by_count"
            ),
            F.when(key % 67 != 0, F.col("n")).alias("num_matched_concepts"),
            *([(key % 4).alias("shard")] if shard else []),
        )
    )


def tagged_orders(t: Tables) -> DataFrame:
    """Order papers with their concepts as an array, like ingest output."""
    arrays = order_edges(t).groupBy("paper_id").agg(
        F.array_sort(F.collect_set("concept")).alias("matched_concepts")
    )
    papers = order_papers(t)
    return papers.join(arrays, papers.id == arrays.paper_id).drop("paper_id")


def arriving_orders(t: Tables) -> list[DataFrame]:
    """Order papers as they arrive in two waves, versions in ``updated_date``.

    By key, in threes: first a wrong version (more citations and a concept too many, a year
    off, a readable title) that the second wave corrects; the right version first and an
    outdated one after it; the right version once. What stands in the end are
    ``order_papers`` and ``order_edges``.
    """
    right = t.kept("tagged_orders", lambda: tagged_orders(t))
    right = right.withColumn("updated_date", F.lit("2024-02-01"))
    key = F.substring("id", 2, 20).cast("long")
    wrong = right.withColumns(
        {
            "title": F.lit("Withdrawn"),
            "abstract": F.lit("Withdrawn."),
            "cited_by_count": F.coalesce("cited_by_count", F.lit(0)) + 500,
            "publication_year": F.coalesce("publication_year", F.lit(1990)) + 1,
            "num_matched_concepts": F.coalesce("num_matched_concepts", F.lit(0)) + 1,
            "matched_concepts": F.concat("matched_concepts", F.array(F.lit("withdrawn"))),
            "updated_date": F.lit("2024-01-01"),
        }
    )
    corrected, outdated = key % 3 == 0, key % 3 == 1
    first = wrong.where(corrected).unionByName(right.where(outdated | (key % 6 == 2)))
    second = right.where(corrected | (key % 6 == 5)).unionByName(wrong.where(outdated))
    return [first, second]


def document_papers(t: Tables) -> DataFrame:
    """Documents as papers with the whole text as abstract."""
    return t.documents().select(
        _document_id(),
        _first_line().alias("title"),
        F.col("text").alias("abstract"),
        _document_year().alias("publication_year"),
        _document_cites().alias("cited_by_count"),
        F.lit(None).cast("int").alias("num_matched_concepts"),
    )


def document_edges(t: Tables) -> DataFrame:
    """Every document under its language and its source."""
    return t.documents().select(
        F.explode(F.array("lang", "source")).alias("concept"),
        _document_id().alias("paper_id"),
    )


def document_texts(t: Tables) -> DataFrame:
    """id and combined title and text."""
    return t.kept("texts", lambda: _document_texts(t))


def document_works(t: Tables) -> DataFrame:
    """Documents as raw works, the text turned into an inverted index."""
    return t.kept("works", lambda: _document_works(t))


def _document_texts(t: Tables) -> DataFrame:
    return t.spread().select(
        _document_id(), "source", F.concat(_first_line(), F.lit(" "), "text").alias("text")
    )


def _document_works(t: Tables) -> DataFrame:
    """Words and positions of an id's texts, which lie in one task, make its index there.

    The words of repeated ids stand in one index, as if their texts lay one over another.
    """
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    texts = F.collect_list(F.when(F.col("doc_id").isNotNull(), words))
    placed = t.spread().withColumn("_texts", texts.over(W.partitionBy("doc_id")))
    return placed.select(
        _document_id(),
        F.lit(None).cast("string").alias("doi"),
        _first_line().alias("title"),
        _inverted_index(F.col("_texts")).alias("abstract_inverted_index"),
        _document_year().alias("publication_year"),
        F.concat(_document_year().cast("string"), F.lit("-01-01")).alias("publication_date"),
        F.col("source").alias("type"),
        _document_cites().alias("cited_by_count"),
        _counts_by_year().alias("counts_by_year"),
        F.concat(F.lit("2024-01-0"), (F.col("doc_id") % 3 + 1).cast("string")).alias("updated_date"),
        F.col("source").alias("source_file"),
    )


def _inverted_index(texts: Column) -> Column:
    """``MAP<STRING, ARRAY<INT>>``: each word of lists of words with its sorted positions.

    Places are sorted by word, so a word's stand in one piece. Null without words.
    """
    places = F.flatten(
        F.transform(
            texts,
            lambda words: F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("pos"))),
        )
    )
    return bind(F.sort_array(places), lambda placed: F.when(F.size(placed) > 0, _by_word(placed)))


def _by_word(placed: Column) -> Column:
    def starts_word(i: Column) -> Column:
        return (i == 0) | (F.get(placed, i)["word"] != F.get(placed, i - 1)["word"])

    def entry(starts: Column, start: Column, k: Column) -> Column:
        end = F.coalesce(F.get(starts, k + 1), F.size(placed)) - 1
        positions = F.transform(F.sequence(start, end), lambda i: F.get(placed, i)["pos"])
        return F.struct(F.get(placed, start)["word"], positions)

    first = F.filter(F.sequence(F.lit(0), F.size(placed) - 1), starts_word)
    return bind(
        first,
        lambda starts: F.map_from_entries(
            F.transform(starts, lambda start, k: entry(starts, start, k))
        ),
    )


def document_batches(t: Tables) -> DataFrame:
    """Two batches of tagged papers: all documents, and the labelled ones again
    later with one citation and one concept more."""
    base = t.documents().select(
        _document_id(),
        _first_line().alias("title"),
        _document_year().alias("publication_year"),
        _document_cites().alias("cited_by_count"),
        F.array("lang", "source").alias("matched_concepts"),
        F.lit(1).alias("batch"),
        F.lit("2024-01-01").alias("updated_date"),
        "doc_id",
    )
    again = base.join(t["labels"].select("doc_id"), "doc_id", "left_semi").withColumns(
        {
            "cited_by_count": F.col("cited_by_count") + 1,
            "matched_concepts": F.concat("matched_concepts", F.array(F.lit("again"))),
            "batch": F.lit(2),
            "updated_date": F.lit("2024-02-01"),
        }
    )
    return base.unionByName(again).drop("doc_id")


def dated_documents(t: Tables) -> DataFrame:
    """Documents with unknown years: null for one in ten, 0 for another."""
    ending = F.col("doc_id") % 10
    year = F.when(ending == 1, F.lit(0)).when(ending != 0, _document_year())
    return t.documents().select(_document_id(), year.alias("publication_year"))


def responses(t: Tables) -> DataFrame:
    """Assistant turns as raw model responses in seven forms."""
    turn = F.concat(F.lit("C"), "conv_id", F.lit("-"), "turn")
    body = F.to_json(F.struct(turn.alias("concept"), F.col("text").alias("summary")))
    form = F.col("conv_id") % 7
    raw = (
        F.when(form == 0, body)
        .when(form == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(
            form == 2,
            F.concat(F.lit("<|channel|>analysis think {\n} more<|end|>\n "), body, F.lit("\n")),
        )
        .when(form == 3, F.expr("substring(body, 1, length(body) - 1)"))
        .when(
            form == 4,
            F.concat(
                F.lit("<|channel|>commentary { about\n it <|end|>"), body,
                F.lit("<|channel|>commentary }<|end|>"),
            ),
        )
        .when(form == 5, F.concat(F.lit("<analysis>{ step\n1 }</analysis>\n```"), body, F.lit("```")))
        .otherwise(F.col("text"))
    )
    return (
        t["conversations"]
        .where(F.col("role") == "assistant")
        .withColumn("body", body)
        .select(
            turn.alias("concept"),
            raw.alias("raw_response"),
            F.floor(F.length("text") / 4).cast("int").alias("tokens_generated"),
            F.lit("stop").alias("finish_reason"),
        )
    )


def shard_copies(t: Tables) -> DataFrame:
    """Documents in four shards, those of even id in the following shard too, with one
    citation more."""
    base = t.documents().select(
        _document_id(),
        (F.col("doc_id") % 4).alias("shard"),
        _document_year().alias("publication_year"),
        _document_cites().alias("cited_by_count"),
        "doc_id",
    )
    again = base.where("doc_id % 2 = 0").withColumns(
        {"shard": (F.col("shard") + 1) % 4, "cited_by_count": F.col("cited_by_count") + 1}
    )
    return base.unionByName(again).drop("doc_id")


def _counts_by_year() -> Column:
    """A JSON list for one document in four, null for the others."""
    entry = F.struct(_document_year().alias("year"), _document_cites().alias("cited_by_count"))
    return F.when(F.col("doc_id") % 4 == 1, F.to_json(F.array(entry)))


def _paper_id(key: str) -> Column:
    return F.concat(F.lit("W"), F.col(key).cast("string")).alias("paper_id")


def _document_id() -> Column:
    return F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("id")


def _first_line() -> Column:
    return F.substring_index("text", "\n", 1)


def _document_year() -> Column:
    return (F.col("doc_id") % 27 + 2000).cast("int")


def _document_cites() -> Column:
    return (F.col("doc_id") * 7919 % 5000).cast("int")
