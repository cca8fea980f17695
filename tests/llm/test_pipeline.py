"""Stages of the pipeline row by row: rows without doc_id, repeated rows, rows that share a doc_id."""

import re
from collections import Counter

import corpus_pipeline
from messy import SECRET, docs, texts
from pyspark.sql import functions as F

from gradus.llm import langid
from gradus.llm.secrets import RULES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM = "one two three four five six seven eight nine ten eleven"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def one_of_each(rows):
    """(doc_id, text, key): one row of each component of Jaccard 3/4, by brute force."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    sets, group = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 4 * len(a & sets[j]) >= 3 * len(a | sets[j]):
                x, y = sorted((group[i], group[j]))
                group = [x if g == y else g for g in group]
    return Counter(rows[g] for g in set(group))


def contaminated(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if x]
    item = ITEM.split()
    return any(w[i : i + 10] in (item[:10], item[1:]) for i in range(len(w)))


def secret(text):
    return any(len(m[r.group]) >= r.least for r in RULES for m in re.finditer(r.pattern, text or ""))


def test_stages_decide_by_row(spark, tmp_path):
    clean = "quiet words about gamma and delta without any harm at all in them"
    rows = [(i * 3, t) for i, t in enumerate(texts()) if t is None or len(t) < 50_000]
    rows += [(None, clean), (None, None), (None, None), (5000, clean + " x"), (5000, clean + " x"), (300, rows[20][1]), (300, rows[20][1])]
    rows += [(6000, "iota kappa zeta theta eta alone"), (6000, SECRET + " other"), (6000, "begin " + ITEM + " end"), (6000, "12345 !!!"), (None, "und der eta " + ITEM), (None, "zeta zeta eta iota kappa nobody else has this")]
    d = docs(spark, rows)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("i", ITEM)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")

    key = F.xxhash64("doc_id", "text").alias("key")
    found = lambda df: Counter(tuple(r) for r in df.select("doc_id", "text", key).collect())
    every = d.select("doc_id", "text", key).collect()
    judged = spark.createDataFrame([(i, r.text) for i, r in enumerate(every)], "doc_id bigint, text string")
    fit = {r.doc_id for r in langid.predict(judged, langid.train(d)).where("not rejected").collect()}
    want = [
        lambda now: Counter(tuple(every[i]) for i in fit),
        lambda now: one_of_each(list(now)),
        lambda now: Counter({r: n for r, n in now.items() if not contaminated(r[1])}),
        lambda now: Counter({r: n for r, n in now.items() if not secret(r[1])}),
    ]
    now = None
    for i, (expect, (name, stage)) in enumerate(zip(want, corpus_pipeline.STAGES)):
        stage(spark, d, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        d = spark.read.parquet(f"{tmp_path}/{i}")
        now = expect(now)
        assert found(d) == now, name
    assert any(r[0] is None for r in now) and sum(r[0] == 6000 for r in now) == 1
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter(r[0] for r in now.elements())
