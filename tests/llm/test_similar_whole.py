"""No link between near-duplicates is lost where both are closer to a third text."""

import random

from pyspark.sql import functions as F

from stampline.llm.similar import PRINTS, candidate_pairs, prints_of, similar_groups
from stampline.llm.texts import texts_of


def test_links_beside_a_closer_text_are_kept(spark):
    """A and B are similar (0.804); C is a candidate of both, similar to neither, and often closer to either."""
    rng, docs, n = random.Random(3), [], 250
    for t in range(n):
        a = [f"w{rng.randrange(10 ** 6)}" for _ in range(50)]
        b, c = list(a), list(a)
        b[25], c[25], c[49] = f"b{t}", f"c{t}", f"e{t}"
        docs += [(3 * t + i, " ".join(words)) for i, words in enumerate((a, b, c))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    _, nodes = similar_groups(frame)
    group = {r.id: r.group for r in nodes.select("id", "group").collect()}
    joined = {t for t in range(n) if group[3 * t] == group[3 * t + 1]}
    alone = prints_of(texts_of(frame, "doc_id", "text"), 5, 42).select(
        F.col("id").alias("node"), F.col("id").alias("group"), "prints").localCheckpoint()
    meet = {(r.a, r.b) for which in range(PRINTS) for r in candidate_pairs(alone, which, apart=True).collect()}
    assert joined == {t for t in range(n) if (3 * t, 3 * t + 1) in meet}
    assert not any(group[3 * t + 2] in (group[3 * t], group[3 * t + 1]) for t in range(n))
