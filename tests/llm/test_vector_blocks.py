"""Blocks of the epsilon grid join: which meet, and what a task returns of them."""

import math

import numpy as np
from pyspark.sql import functions as F

from reliaspan.llm import embedding_join as ej


def test_links_of_a_task_are_one_row_per_vector():
    node, links, to = np.array([5, 7, 9, 7, 20, 21]), np.array([1, 2, 3, 4, 1, 1]), np.array([5, 5, 7, 7, 20, 20])
    assert [v.tolist() for v in ej._merged(node, links, to)] == [[5, 7, 9, 20, 21], [1, 6, 3, 1, 1], [5, 5, 5, 20, 20]]


def test_blocks_meet_without_being_shuffled_for_a_pair(spark):
    rng = np.random.default_rng(4)
    rows = [(i, 1, rng.normal(size=8).tolist()) for i in range(400)]
    classes = spark.createDataFrame(rows, "node long, copies long, vector array<double>")
    eps = math.sqrt(0.1)
    blocks = ej._blocks(classes, ej._directions(classes, 8), eps, 16)
    met = ej._meeting(blocks, eps, 400)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    box = {r["block"]: [(r[f"low{k}"], r[f"high{k}"]) for k in range(ej.DIRECTIONS)] for r in blocks.collect()}
    gap = lambda a, b: sum(max(0, x[0] - y[1], y[0] - x[1]) ** 2 for x, y in zip(box[a], box[b]))
    want = {(a, b) for a in box for b in box if a <= b and gap(a, b) <= (eps + ej.SLACK) ** 2}
    got = [(r["block_a"], r["block_b"]) for r in met.select("block_a", "block_b").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) < len(box) * (len(box) + 1) / 2
    one = blocks.agg(F.count("*")).first()[0]
    assert one == len(box) > 10
