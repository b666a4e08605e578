"""Language identification by compression.

For each language a raw-content zstandard dictionary is filled with training
texts.  A text gets the language whose dictionary compresses it to the fewest
bytes; where the best two sizes are too close the text is rejected.

Defined results: null texts and texts without a letter get ``und`` and score
0.  Ties go to the language with more training rows, then to the smaller name,
and count as narrow margins.  Repeated rows are predicted alike; an empty table
gives an empty result; other columns of the input are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import pieces

UNDETERMINED = "und"
#: Lower-case ASCII letters and the bytes of other characters stay; all else is a space.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal_form(text: str | None) -> bytes:
    """Lower case, runs of anything but letters as one space, with a space at both ends."""
    if not text:
        return b""
    kept = b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())
    return b" " + kept + b" " if any(c.isalpha() for c in text) else b""


@dataclass(frozen=True)
class DictionaryModel:
    """Languages in tie order, their dictionaries, and how texts are cut and compressed.

    Texts are compressed whole, in segments of ``segment`` bytes so that the
    dictionary stays in reach of all of a long text.
    """

    dictionaries: tuple[tuple[str, bytes], ...]
    segment: int = 8192
    short: int = 1000
    short_level: int = 12
    level: int = 6
    min_margin: float = 0.005

    def scorer(self):
        """text -> (language, score, margin, rejected); made once per task."""
        langs = [name for name, _ in self.dictionaries]

        def compressors(level: int):
            made = []
            for _, raw in self.dictionaries:
                content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                content.precompute_compress(level=level)
                made.append(
                    zstandard.ZstdCompressor(
                        level=level, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False
                    )
                )
            return made

        if not langs:
            return lambda text: (UNDETERMINED, 0.0, 0.0, True)
        short, long = compressors(self.short_level), compressors(self.level)

        def score(text: str | None):
            body = normal_form(text)
            if not body:
                return UNDETERMINED, 0.0, 0.0, True
            use = short if len(body) <= self.short else long
            cuts = [body[i : i + self.segment] for i in range(0, len(body), self.segment)]
            sizes = [sum(len(c.compress(cut)) for cut in cuts) for c in use]
            best = min(range(len(sizes)), key=sizes.__getitem__)
            rest = [s for i, s in enumerate(sizes) if i != best]
            margin = (min(rest) - sizes[best]) / sizes[best] if rest else 1.0
            # a byte saved is worth a fixed number of nats, less on long texts whose savings are correlated
            weight = 0.7 / math.sqrt(1 + len(body) / 100)
            total = sum(math.exp(-weight * (s - sizes[best])) for s in sizes)
            return langs[best], 1.0 / total, margin, margin < self.min_margin

        return score


def excerpt(text_col: str, size: int) -> Column:
    """The text's bytes; of one over ``size`` bytes so many at a place that its hash gives."""
    start = F.pmod(F.xxhash64(text_col), F.greatest(F.octet_length(text_col) - size, F.lit(0)) + 1)
    return F.substring(F.col(text_col).cast("binary"), start.cast("int") + 1, F.lit(size))


def fit(
    docs: DataFrame,
    train: Column,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    dictionary_bytes: int = 65536,
    sample_rows: int = 400,
    max_languages: int = 200,
    **options,
) -> DictionaryModel:
    """Learn dictionaries from the rows where ``train`` holds and the label is not null.

    This is a fit on a bounded sample of labelled rows: per language the
    ``sample_rows`` or so rows with the smallest id hash, of which texts enter
    the dictionary until ``dictionary_bytes`` are full.  Of a text over an eighth
    of that, an excerpt of this size at a hashed place enters.  The driver sees
    at most ``max_languages * sample_rows`` rows or so; rarer languages than the
    first ``max_languages`` are not learned.
    """
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("h")
    )
    usual = dictionary_bytes // 8
    counts = (
        rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    )
    if not counts:
        return DictionaryModel((), **options)
    space = 1 << 40
    share = {r["lang"]: min(space, space * sample_rows // r["count"] + 1) for r in counts}
    limit = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
    picked = (
        rows.where(F.pmod("h", F.lit(space)) < limit[F.col("lang")])
        .select("lang", "h", excerpt("text", usual).alias("text"))
        .collect()
    )
    made = []
    for r in counts:
        body = bytearray()
        for x in sorted((p["h"], p["text"]) for p in picked if p["lang"] == r["lang"]):
            form = normal_form(x[1].decode("utf-8", "ignore"))  # without the bytes of characters cut at an end
            if form and len(body) + len(form) <= dictionary_bytes:
                body += form
        made.append((r["lang"], bytes(body) or b" " * 8))
    return DictionaryModel(tuple(made), **options)


def classify_batches(model: DictionaryModel, batches: Iterator[pa.RecordBatch], text_index: int):
    """(slice of the input, languages, scores, margins, rejections) for bounded slices."""
    score = model.scorer()
    for batch in batches:
        for part in pieces(batch, text_index):
            found = [score(x) for x in part.column(text_index).to_pylist()]
            yield part, *(list(x) for x in zip(*found))


def identify(docs: DataFrame, model: DictionaryModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``lang_pred``, ``score``, ``margin`` (relative size gap) and ``rejected``."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches):
        for part, langs, scores, margins, rejected in classify_batches(model, batches, 1):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[id_col, "lang_pred", "score", "margin", "rejected"],
            )

    return rows.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, margin double, rejected boolean")


def keep_identified(docs: DataFrame, model: DictionaryModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their columns unchanged."""
    at = docs.columns.index(text_col)

    def run(batches):
        for part, _, _, _, rejected in classify_batches(model, batches, at):
            yield part.filter(pa.array([not r for r in rejected], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
