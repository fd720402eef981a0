"""Language identification by rank order: the most frequent n-grams of a text against those of each language.

N-grams have one to three characters and lie within a word that is padded with one space at each side; words
are runs of letters and marks, in lower case.  A profile holds the ``PROFILE`` most frequent n-grams, ties in
order of the n-gram.  The distance of a text to a language is the sum, over the text's own profile, of how far
each n-gram's rank is out of place (``PROFILE`` where the language lacks it), divided by its greatest possible
value, so that it lies in 0..1.

Defined results: a null or empty text, or one without letters, has no n-grams and is rejected with a null
language and distance 1; a tie between languages goes to the name first in order; repeated rows get equal
results; an empty table gives an empty table; with no labelled language at all, every text is rejected; extra
columns pass through and one that clashes with a new name is replaced; ``stage`` keeps every column as it is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField

from . import textkernel as K
from .columns import append, dropping, unused
from .store import cut

#: N-grams in a profile.
PROFILE = 300
#: At most so many labelled texts per language train its profile: a bounded sample, in a pseudo-random order of the ids.
PER_LANGUAGE = 2000
#: A text farther than this from every language is rejected.  Few are (README): mixtures of known languages can lie nearer, and are kept.
FARTHEST = 0.6
#: Up to so many ids are broadcast to pick the texts of the sample; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_SPREAD, _MOD = 2654435761, 4294967291

_KINDS = [StringType(), DoubleType(), DoubleType(), BooleanType()]


def grams(codes: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Key of every n-gram of one text: three code points of 21 bits each, absent ones 0."""
    x = np.full(len(codes) + 2, 32, np.int64)
    x[1:-1] = np.where(member, codes, 32)
    keep = x != 32
    keep[1:] |= x[:-1] != 32
    keep[0] = True
    x = x[keep]
    if len(x) < 2:
        return np.zeros(0, np.int64)
    inner = x[1:-1] != 32
    pair = (x[:-1] << 42) | (x[1:] << 21)
    return np.concatenate([x[x != 32] << 42, pair, (pair[:-1] | x[2:])[inner]])


def profile(keys: np.ndarray, size: int) -> np.ndarray:
    """The most frequent keys in order of rank."""
    if not len(keys):
        return keys
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.concatenate([first, [len(keys)]]))
    return keys[first[np.argsort(-counts, kind="stable")[:size]]]


def text_grams(texts: list[str]) -> Iterator[np.ndarray]:
    """The n-grams of each text in turn."""
    lower, kind = K.lower_table(), K.char_class()
    for c in K.chunks(texts):
        member = (kind[c.cp] == K.LETTER) | (kind[c.cp] == K.MARK)
        low = lower[c.cp]
        for a, b in zip(c.off[:-1], c.off[1:], strict=True):
            yield grams(low[a:b], member[a:b])


@dataclass(frozen=True)
class Profiles:
    """Ranks of each n-gram in each language; ``size`` where it is absent."""

    names: list[str]
    keys: np.ndarray
    ranks: np.ndarray
    size: int


def train(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", size: int = PROFILE, per_language: int = PER_LANGUAGE) -> Profiles:
    """Profiles of the languages named in ``lang``, from at most ``per_language`` texts each."""
    labelled = df.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull())
    order = Window.partitionBy("lang").orderBy((F.pmod(F.col("id"), F.lit(_MOD)) * F.lit(_SPREAD)) % F.lit(_MOD), "id")
    # only ids are ranked; at most per_language ids of each language come back to pick the texts
    chosen = labelled.select(F.col(lang).alias("lang"), F.col(doc_id).cast("long").alias("id")).distinct().withColumn("at", F.row_number().over(order)).where(F.col("at") <= per_language).select("lang", "id")
    chosen = cut(chosen)
    # size-checked: it grows with the names in ``lang``
    few = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen
    sample = labelled.select(F.col(lang).alias("lang"), F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(few, ["lang", "id"], "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[np.ndarray]] = {}
        for b in K.slices(batches):
            langs = b.column(0).to_pylist()
            for name, g in zip(langs, text_grams(K.strings(b.column(1))), strict=True):
                total.setdefault(name, []).append(np.stack(np.unique(g, return_counts=True)))
        for name, parts in total.items():
            both = np.concatenate(parts, axis=1)
            keys, at = np.unique(both[0], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(np.bincount(at, both[1]).astype(np.int64))], names=["lang", "gram", "n"])

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("at") <= size)
    rows = ranked.select("lang", "gram", "at").collect()  # languages x size rows
    names = sorted({r[0] for r in rows}, key=lambda x: x.encode())
    keys = np.array(sorted({r[1] for r in rows}), np.int64)
    ranks = np.full((len(names), len(keys)), size, np.int64)
    if rows:
        ranks[[names.index(r[0]) for r in rows], np.searchsorted(keys, [r[1] for r in rows])] = [r[2] - 1 for r in rows]
    return Profiles(names, keys, np.where(ranks < size, ranks, -1), size)


def distances(p: Profiles, keys: np.ndarray) -> np.ndarray:
    """Sum of out-of-place ranks of one text's profile, by language."""
    at = np.searchsorted(p.keys, keys)
    at[at == len(p.keys)] = 0
    known = p.keys[at] == keys
    rank = p.ranks[:, at]
    return np.where(known & (rank >= 0), np.abs(rank - np.arange(len(keys))), p.size).sum(axis=1)


def identify(df: DataFrame, p: Profiles, text: str = "text", farthest: float = FARTHEST, names: Sequence[str] = ("predicted_lang", "distance", "margin", "accepted")) -> DataFrame:
    """``df`` with ``predicted_lang``, ``distance``, ``margin`` to the second language, and ``accepted``, or by other names."""

    def make(texts: list[str]) -> list[list]:
        out: list[list] = [[], [], [], []]
        for g in text_grams(texts):
            row = (None, 1.0, 0.0, False)
            if len(g) and p.names:
                own = profile(g, p.size)
                d = distances(p, own)
                best = int(d.argmin())
                most = len(own) * p.size
                second = int(np.delete(d, best).min()) if len(d) > 1 else most
                row = (p.names[best], int(d[best]) / most, (second - int(d[best])) / most, int(d[best]) / most <= farthest)
            for o, v in zip(out, row, strict=True):
                o.append(v)
        return out

    return append(df, text, [StructField(n, k) for n, k in zip(names, _KINDS, strict=True)], make)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that has a recognised language, with it and the distance; rejected documents are left out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    p = train(docs)
    return identify(docs, p).where("accepted").select("doc_id", "lang", "predicted_lang", F.round("distance", 9).alias("distance"), F.round("margin", 9).alias("margin"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is recognised, with their own columns, whatever their names."""
    own = unused(docs, "lang", "distance", "margin", "accepted")
    return dropping(identify(docs, train(docs), names=own).where(F.col(own[3])), *own)


def sql(size: int = PROFILE, per_language: int = PER_LANGUAGE, farthest: float = FARTHEST) -> str:
    """The query in DuckDB's SQL."""
    return f"""
WITH chosen AS (
  SELECT lang, doc_id FROM (SELECT DISTINCT lang, doc_id FROM documents WHERE lang IS NOT NULL AND doc_id IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY ((doc_id % {_MOD} + {_MOD}) % {_MOD} * {_SPREAD}) % {_MOD}, doc_id) <= {per_language}),
split AS (
  SELECT doc_id, lang, unnest(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{M}}]+', ' ', 'g'), ' '), ' ')) AS w FROM documents),
padded AS (SELECT doc_id, lang, ' ' || w || ' ' AS s, count(*) AS times FROM split WHERE w <> '' GROUP BY ALL),
spots AS (SELECT doc_id, lang, s, times, unnest(generate_series(1, length(s))) AS i FROM padded),
pieces AS (SELECT doc_id, lang, substr(s, i, n) AS g, n, times FROM spots, (SELECT unnest([1, 2, 3]) AS n) WHERE i + n - 1 <= length(s)),
counted AS (SELECT doc_id, lang, g, sum(times) AS n FROM pieces WHERE g <> ' ' GROUP BY doc_id, lang, g),
own AS (
  SELECT doc_id, lang, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) - 1 AS r FROM counted
  QUALIFY r < {size}),
ranked AS (
  SELECT lang AS name, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) - 1 AS r
  FROM (SELECT lang, g, sum(n) AS n FROM counted SEMI JOIN chosen USING (lang, doc_id) GROUP BY ALL)
  QUALIFY r < {size}),
names AS (SELECT DISTINCT name FROM ranked),
far AS (
  SELECT own.doc_id, own.lang, names.name, sum(coalesce(abs(own.r - ranked.r), {size})) AS d, count(*) * {size} AS most
  FROM own CROSS JOIN names LEFT JOIN ranked ON ranked.name = names.name AND ranked.g = own.g GROUP BY ALL),
best AS (
  SELECT doc_id, lang, name, d, most, row_number() OVER (PARTITION BY doc_id ORDER BY d, name) AS k,
    coalesce(lead(d) OVER (PARTITION BY doc_id ORDER BY d, name), most) AS second FROM far)
SELECT doc_id, lang, name AS predicted_lang, round(d / most, 9) AS distance, round((second - d) / most, 9) AS margin
FROM best WHERE k = 1 AND d / most <= {farthest}"""
