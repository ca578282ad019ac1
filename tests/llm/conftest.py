import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """A few documents with copies, nulls, repeats and extra columns of clashing names."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(5, 120))) for _ in range(60)]
    texts += [texts[0], texts[0] + " tail", texts[1].upper(), "", None, "   ", "one", "Ärger über ça", "\n\n", "word " * 5000]
    rows = [(i, t, None if i % 11 == 0 else "en", None if i % 13 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], (None, "no id here at all", "en", "s1", 17), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, DOC_SCHEMA)
    names = ("fp", "h", "key", "component_id", "shard", "score", "bucket", "found", "spans", "a", "rep", "_row")
    return frame.selectExpr("*", *[f"'x' as {n}" for n in names])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
