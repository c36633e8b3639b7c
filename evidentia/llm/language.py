"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language has a raw-content zstandard dictionary made of texts known to be in it. A text (lower-cased, all ASCII but
letters and apostrophes as single spaces) is encoded with each dictionary, in stretches of STRETCH bytes so that the
dictionary matters all along; the smallest sum wins. The margin is the share by which the second is larger; a narrow
one is rejected (`accepted` is false), and the best guess still stands in lang_pred.

The fit takes a bounded sample of the labelled rows: of each language `per_language` different texts, those of the least
hashes, and of each text one stretch of STRETCH_CHARS characters from a hashed place. All stretches stand in the
dictionary, each with an even share of its bytes. Every language is learnt; where there are more than TOTAL_BYTES /
DICT_BYTES of them, the dictionaries shrink in proportion, so that all together keep to TOTAL_BYTES. Rows are thinned by
hash before they are ranked, so a language that most rows have costs no task more than others; a text that is repeated
counts once. Rows of a null text or language are not learnt from.

A null text, or one without a letter, is `und` with score 0. With nothing to learn from, all are `und`. Whole texts of any
length are encoded. Ties go to the language first in the alphabet. Repeated rows give a row each; an empty table gives
none. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

DICT_BYTES, TOTAL_BYTES, STRETCH, LEVEL, NARROW = 128 << 10, 32 << 20, 8 << 10, 6, 0.01
STRETCH_CHARS = 600
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A or b == 0x27 else 0x20 for b in range(256))
_ASCII_LETTER = re.compile(r"[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def normal(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


def dictionary(texts: list[str], size: int = DICT_BYTES) -> bytes:
    """Raw content: an even share of each text, the last bytes (nearest to what is encoded) from the last text."""
    share = max(1, size // max(1, len(texts)) - 1)
    return b" ".join(normal(t)[:share] for t in texts)


class Encoders:
    def __init__(self, content: dict[str, bytes]):
        import zstandard

        self.names, self.encoders = sorted(content), []
        for name in self.names:
            held = zstandard.ZstdCompressionDict(content[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.encoders.append(zstandard.ZstdCompressor(dict_data=held, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted)."""
        if not self.names or not text or not has_letter(text):
            return "und", 0.0, False
        plain = normal(text)
        stretches = [plain[i : i + STRETCH] for i in range(0, len(plain), STRETCH)]
        sizes = [sum(len(e.compress(s)) for s in stretches) for e in self.encoders]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = order[0]
        if len(order) == 1:
            return self.names[best], 1.0, True
        margin = sizes[order[1]] / max(1, sizes[best]) - 1
        return self.names[best], min(1.0, 0.5 + 5 * margin), margin >= NARROW


def sampled(known: DataFrame, per_language: int) -> dict[str, list[str]]:
    """Stretches of texts by language."""
    named = known.where("lang is not null and text is not null and length(text) > 0").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    named = named.withColumn("h", F.xxhash64("text"))
    sizes = {r.lang: r.n for r in named.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return {}
    most = max(1, min(per_language, TOTAL_BYTES // len(sizes) // 512))
    # Of a language's hashes a share is kept that holds some eight times as many as are wanted.
    kept = known.sparkSession.createDataFrame([(name, min(1.0, 8 * most / max(1, n))) for name, n in sizes.items()], "lang string, share double")
    first = F.pmod(F.xxhash64("h", F.lit(1)), F.greatest(F.length("text") - STRETCH_CHARS + 1, F.lit(1)).cast("long")).cast("int")
    thin = named.join(F.broadcast(kept), "lang").where(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    thin = thin.select("lang", "h", F.substring("text", first + 1, F.lit(STRETCH_CHARS)).alias("text")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    rows = thin.withColumn("n", place).where(F.col("n") <= most).collect()
    found: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r.n)):
        found.setdefault(row.lang, []).append(row.text)
    return found


def languages(docs: DataFrame, known: DataFrame, per_language: int = 256) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of docs, learnt from the rows of known (text, lang)."""
    spark = docs.sparkSession
    learnt = sampled(known, per_language)
    size = min(DICT_BYTES, TOTAL_BYTES // max(1, len(learnt)))
    content = {name: dictionary(texts, size) for name, texts in learnt.items()}
    shared = spark.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(shared.value)
        for batch in batches:
            rows = [encoders.predict(value.as_py()) for value in batch.column(1)]
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            kinds = (pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
