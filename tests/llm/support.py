"""Small tables with the awkward rows that every operator has to take, and a comparison with DuckDB."""

import math

import duckdb

LONG = "the quick brown fox jumps over the lazy dog 12 times " * 6000
TEXTS = [None, "", "   \n\t", "one", "same text here and there again", "same text here and there again", LONG, "!!! ??? ...", "été naïve Größe", "a\nb\n\nc", "12345 67890", "日本語の文章 です", "tab\tand\r\nline", "x" * 5000, "é combined", "😀 smile 😀"]
#: Columns whose names clash with those that the operators add, in other letters too.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, KEPT string, quality_score string, Token_IDs string, n_tokens string, perplexity string, n_words string, Distance string, accepted string, id string, a string, __id string"


def awkward(spark, extra=True):
    """Documents with null ids, null and empty texts, a long one, repeated rows and clashing columns."""
    rows = [(i, t, ["en", None, "fr"][i % 3], "s", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id at all", "en", None, 12), rows[4], rows[0]]
    if extra:
        return spark.createDataFrame([(*r, *["x"] * 11) for r in rows], CLASH)
    return spark.createDataFrame([r for r in rows], CLASH.split(", KEPT")[0])


def empty(spark):
    return spark.createDataFrame([], CLASH.split(", KEPT")[0])


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def duck(sf_dir, sql):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def same(df, sf_dir, sql):
    """Asserts that a DataFrame has the rows of the SQL."""
    names, rows = duck(sf_dir, sql)
    assert sorted(df.columns) == sorted(names)
    key = lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r)
    ours = sorted((tuple(norm(r[n]) for n in sorted(names)) for r in df.collect()), key=key)
    theirs = sorted((tuple(norm(r[names.index(n)]) for n in sorted(names)) for r in rows), key=key)
    assert len(ours) == len(theirs)
    assert ours == theirs
