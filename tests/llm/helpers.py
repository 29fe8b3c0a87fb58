import random

WORDS = "the of and to in is that for on as with by this from are at or an it be".split()


def sentence(rng, n, vocabulary=None):
    own = vocabulary or [a + b for a in WORDS for b in WORDS]
    return " ".join(rng.choice(own) for _ in range(n))


def rng(seed=1):
    return random.Random(seed)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, lang=None, start=0):
    """documents of (text) or (doc_id, text)."""
    rows = [t if isinstance(t, tuple) else (start + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, lang(i) if lang else "en", "s", len(t or "")) for i, t in rows], DOCS)


def clashing(df):
    """With further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = "key size shard h n node label band chunk token line at doc score rank items windows data bucket part first low digest".split()
    return df.withColumns({c: F.lit("x") for c in names})
