"""Pairs and groups of findings without lines against plain versions."""

import random
import time

import pytest
from pyspark.sql import functions as F

from codeseam.operators import dedup, likeness


def rows(n=400):
    r = random.Random(8)
    words = ["", "a", "ab", "Outdated", "outdated package", "package left", "Vulnerable: left-pad", "vulnerable: left-pad@1.0", "é", "éé x"]
    out = []
    for i in range(n):
        title, message = r.choice(words) + r.choice(["", f" {r.randrange(30)}"]), r.choice([None, "", f"m{r.randrange(99)}z", "update"]) if r.random() < 0.5 else f"unique message {i}"
        out.append((i, r.choice(["x", "y"]), r.choice(["vulnerable_dependency", "outdated_dependency", "code_smell"]), r.choice([None, None, 5, 9, 30]), r.choice([None, "", "r1", "r2", f"r{i}", f"r{i}"]), title, message, r.choice([None, "f", "g"]), r.choice([None, "C", "D", "E"])))
    return out


COLUMNS = "ingest_seq long, file_path string, finding_type string, line_start int, rule_id string, title string, message string, function_name string, class_name string"


def group_of(spark):
    from codeseam.schemas import type_group

    kinds = ["vulnerable_dependency", "outdated_dependency", "code_smell"]
    df = spark.createDataFrame([(k,) for k in kinds], "finding_type string").select("finding_type", type_group("finding_type").alias("g"))
    return dict(map(tuple, df.collect()))


def alike(a, b):
    def held(x, y):
        x, y = (x or "").lower(), (y or "").lower()
        return bool(x and y and (x in y or y in x))

    return bool(a[4] and a[4] == b[4]) or held(a[5], b[5]) or held(a[6], b[6])


def near(a, b):
    if a[3] is not None and b[3] is not None:
        return abs(a[3] - b[3]) <= 5
    return a[7] == b[7] or a[8] == b[8]


@pytest.fixture(scope="module")
def findings(spark):
    return spark.createDataFrame(rows(), COLUMNS).repartition(3)


def test_groups(spark, findings):
    group, leaders, want = group_of(spark), [], {}
    for x in rows():
        head = next((y for y in leaders if y[1] == x[1] and group[y[2]] == group[x[2]] and near(x, y) and alike(x, y)), None)
        want[x[0]] = head[0] if head else x[0]
        if head is None:
            leaders.append(x)
    assert {r.ingest_seq: r.leader for r in dedup.leader_groups(findings).collect()} == want
    assert 20 < len(leaders) < 300


def test_pairs(spark, findings):
    group, found = group_of(spark), rows()
    want = {(x[0], y[0]) for x in found for y in found if x[0] < y[0] and x[1] == y[1] and group[x[2]] == group[y[2]] and near(x, y) and alike(x, y)}
    got = [(r.a, r.b) for r in dedup.similar_pairs(findings).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_containing(spark):
    texts = [(i, t) for i, t in enumerate([None, "", "a", "ba", "bab", "abab", "xabab", "zz", "é", "aé", "abab"])]
    df = spark.createDataFrame(texts, "n long, text string").withColumn("key", F.lit(1))
    got = {(r.inner, r.outer) for r in likeness.containing(df, ["key"]).collect()}
    assert got == {(i, j) for i, a in texts for j, b in texts if i != j and a and b and a in b}


def test_many_of_one_manifest():
    """Very many findings without lines in one file: seconds, where comparing all with all takes hours."""
    leaders, began = likeness.Leaders(), time.process_time()
    for i in range(20_000):
        texts = f"vulnerable dependency: pkg-{i * 7919 % 1_000_003:07}", f"cve-2024-{i:06} in pkg"
        assert leaders.first(f"r{i}", texts) is None
        leaders.add((i, i), f"r{i}", texts)
    assert leaders.first(None, ("pkg-0007919", "")) == (1, 1)
    assert time.process_time() - began < 60
