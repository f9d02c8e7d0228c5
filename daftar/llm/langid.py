"""Language identification by compression.

For each language a bounded sample of labelled texts, taken whole, gives the words that stand in
most of its documents, and these become the language's raw-content zstandard
dictionary, the commonest last.  A word stays only where its share of documents is
the largest of all languages, so a passage in another language doesn't teach it.
A text's letters are compressed, whole, in blocks, with every dictionary; the language
whose dictionary leaves the fewest bytes wins, and a narrow margin over the next one
marks the prediction as rejected.  The sample is drawn by the smallest hashes of the
ids in each language, so it doesn't depend on how rows are laid out.  Prediction doesn't
shuffle; it takes a pass for every ``LANGUAGES`` languages, so neither the driver nor a
task holds more dictionaries than that, however many languages there are.

Defined cases: null text, or text without a letter, is ``und`` with score 0; with no
labelled rows at all every text is ``und``; equal sizes go to the language with
more labelled ids, then the first in order; labels that are null take no part; a very long
text is compressed whole; repeated rows get equal results, and count once in what is learned where
their ids are equal (the smallest text), however many they are; an empty table gives an empty one.  Extra columns of
any name are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import zstandard
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daftar.llm.scratch import Scratch

#: Documents in a language's sample; their whole texts count.
SAMPLE_DOCS = 400
#: Least documents of the sample that have a word, and bytes of a dictionary.
LEAST_DOCS, DICTIONARY_BYTES = 2, 16_000
#: Languages whose dictionaries are broadcast together (4 MB).
LANGUAGES = 256
BLOCK_BYTES = 8 << 10
LEVEL = 6
#: A relative margin below this is narrow.
MARGIN = 0.01


def letters(text: F.Column) -> F.Column:
    """Lowered runs of letters, one space before each; null where there is none."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"\P{L}+", " "))
    return F.when(plain != "", F.concat(F.lit(" "), plain))


def dictionaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, n, content)``: labelled ids and raw-content dictionary of each language, from a bounded sample of its rows."""
    own = (F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").alias("lang"))
    rows = docs.select(*own).dropna()
    scratch = Scratch(docs.sparkSession, "languages")
    counts = scratch.write(rows.groupBy("lang").agg(F.countDistinct("id").alias("n")))
    # of n ids, about 3 samples' worth have a hash below this share; the smallest of them are the sample
    place = F.xxhash64("id")
    near = rows.join(counts, "lang").where(place.cast("double") / 2.0**64 + 0.5 <= 3.0 * SAMPLE_DOCS / F.col("n"))
    near = near.groupBy("lang", place.alias("place"), "id").agg(F.min("t").alias("t"))
    first = Window.partitionBy("lang").orderBy("place", "id")
    sample = scratch.write(near.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= SAMPLE_DOCS))
    own = sample.select("lang", F.explode(F.array_distinct(F.split(F.ltrim(letters(F.col("t"))), " "))).alias("word"))
    size = sample.groupBy("lang").agg(F.count("*").alias("of"))
    share = F.col("k") / F.col("of")
    best = F.max(share).over(Window.partitionBy("word"))
    kept = own.groupBy("lang", "word").agg(F.count("*").alias("k")).join(size, "lang")
    kept = kept.withColumn("best", best).where((F.col("k") >= LEAST_DOCS) & (share >= F.col("best")))
    common = Window.partitionBy("lang").orderBy(F.desc("k"), "word")
    kept = kept.withColumn("held", F.sum(F.octet_length("word") + 1).over(common)).where(F.col("held") <= DICTIONARY_BYTES)
    words = F.transform(F.sort_array(F.collect_list(F.struct("k", "word"))), lambda x: x["word"])
    made = kept.groupBy("lang").agg(F.array_join(words, " ").alias("words"))
    content = F.concat(F.lit(" "), F.coalesce("words", F.lit("")), F.lit(" ")).cast("binary")
    return scratch.write(counts.join(made, "lang", "left").select("lang", "n", content.alias("content")))


def _sizes(text: bytes, compressors: list[zstandard.ZstdCompressor]) -> list[int]:
    blocks = [text[i : i + BLOCK_BYTES] for i in range(0, len(text), BLOCK_BYTES)]
    return [sum(len(c.compress(b)) for b in blocks) for c in compressors]


def _blocks(learned: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    """Languages with their dictionaries, the commonest first, fetched some at a time; at least one block."""
    rows = learned.orderBy(F.desc("n"), "lang").select("lang", "content").toLocalIterator()
    while True:
        block = [(r.lang, bytes(r.content)) for r in islice(rows, LANGUAGES)]
        yield block
        if len(block) < LANGUAGES:
            return


STATE = "first long, second long, lang_pred string"


def predict(docs: DataFrame, learned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, lang_pred, score, rejected)`` for every row.

    The score rises from 0 with the relative margin over the next language; it is 1 where
    only one language is known.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "language")
    none = (F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("second"), F.lit(None).cast("string").alias("lang_pred"))
    rows, written = docs.select(F.col(f"`{id_col}`").alias("id"), letters(F.col(f"`{text_col}`")).alias("t"), *none), None
    kind = docs.schema[id_col].dataType.simpleString()

    def searcher(shared: Broadcast, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = []
            for _, raw in shared.value:
                content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                content.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_dict_id=False))
            for batch in batches:
                out = []
                for text, first, second, name in zip(batch.column(1), *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                    value = text.as_py()
                    for (lang, _), size in zip(shared.value, _sizes(value.encode(), made) if value is not None else [], strict=False):
                        if first is None or size < first:
                            first, second, name = size, first, lang
                        elif second is None or size < second:
                            second = size
                    out.append((first, second, name))
                found = [pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))]
                own = ["id"] if last else ["id", "t"]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(own))), *found], [*own, "first", "second", "lang_pred"])

        return run

    blocks = _blocks(learned)
    block = next(blocks)
    while True:
        following = next(blocks, [])
        shared = spark.sparkContext.broadcast(block)
        rows = rows.mapInArrow(searcher(shared, not following), f"id {kind}, {STATE}" if not following else f"id {kind}, t string, {STATE}")
        if not following:
            break
        rows = scratch.write(rows)
        shared.destroy()
        scratch.drop(written)
        written, block = rows, following
    margin = F.when(F.col("second").isNull(), 1.0).otherwise(1 - F.col("first") / F.col("second"))
    score = F.when(F.col("second").isNull(), 1.0).otherwise(margin / (margin + MARGIN))
    known = F.col("lang_pred").isNotNull()
    return rows.select(
        F.col("id").alias(id_col), F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.when(known, score).otherwise(0.0).alias("score"),
        (~known | (margin < MARGIN)).alias("rejected"),
    )


def held_out(id_col: str = "doc_id") -> F.Column:
    """The fold that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: its fold, the predicted language and a score."""
    learned = dictionaries(docs.where(~held_out()))
    return predict(docs, learned).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
