import random
import re

import plain

from inkweave.llm import licenses

SCHEMA = "doc_id long, text string, tokens string, at int, known string"


def by_hand(text, every):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(plain.LOWER))
    at = [(k, t) for t in every for k in range(len(w)) if w[k : k + len(t.phrase)] == t.phrase]
    shares = [sum(0 <= k - t.at + j < len(w) and w[k - t.at + j] == x for j, x in enumerate(t.words)) / len(t.words) for k, t in at]
    base = [k for k, t in at if t.base]
    return (len(w), len(base), min(base, default=None), max(base, default=None), ",".join(sorted({t.label for _, t in at if t.base})), ",".join(sorted({t.label for _, t in at})), round(max(shares, default=0), 9))


def run(spark, texts, **kw):
    docs = spark.createDataFrame([(k if k % 5 else None, t, "x", 1, "y") for k, t in enumerate(texts)], SCHEMA).repartition(3)
    return sorted(((*r[:7], round(r[7], 9)) for r in map(tuple, licenses.scan(docs, **kw).collect())), key=str)


def expected(texts, every):
    return sorted(((k if k % 5 else None, *by_hand(t, every)) for k, t in enumerate(texts)), key=str)


def test_labels_and_score_equal_brute_force(spark):
    r, every = random.Random(1), [*licenses.BASE, *licenses.TEMPLATES]
    pool = [w for t in every for w in t.words]
    texts = [None, "", " ", "cc by", "by cc by cc by nc", "license " * 500, "É" * 9000, "all rights reserved all rights reserved", "x" * 100_000, "Cc-BY 4.0, GNU General Public License version 3"]
    for _ in range(150):
        words = [r.choice(pool) for _ in range(r.randint(0, 20))]
        for _ in range(r.randint(0, 3)):
            t = r.choice(every)
            part = t.words if r.random() < 0.5 else t.phrase
            words[r.randint(0, len(words)) : 0] = part if r.random() < 0.8 else part[:-1]
        texts.append(r.choice([" ", "-", ".\n"]).join(w.upper() if r.random() < 0.2 else w for w in words))
    assert run(spark, texts) == expected(texts, every)
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_hundreds_of_templates_are_one_index(spark):
    r = random.Random(2)
    words = [f"w{k}" for k in range(150)]
    many = []
    for k in range(400):
        text = [r.choice(words) for _ in range(r.randint(1, 12))]
        a = r.randrange(len(text))
        many.append(licenses.Template(f"l{k % 90}", " ".join(text), " ".join(text[a : a + r.randint(1, 5)])))
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 300))) for _ in range(40)] + [t.text for t in many[:60]]
    assert run(spark, texts, templates=many) == expected(texts, [*licenses.BASE, *many])
    docs = spark.createDataFrame([(1, "w1 w2")], "doc_id long, text string")
    nodes = [licenses.scan(docs, templates=m)._jdf.queryExecution().executedPlan().toString().count("\n") for m in (many[:5], many)]
    assert nodes[0] == nodes[1] and "Python" not in licenses.scan(docs, templates=many)._jdf.queryExecution().executedPlan().toString()
    assert len(licenses.scan(docs, templates=many).columns) == 8
