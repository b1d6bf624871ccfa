import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from toposim.llm import spelling as sp


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(count):
    form = {}
    links = {w: [x for x in count if near(w, x)] for w in count}
    for w, xs in links.items():
        if xs:
            b = min(xs, key=lambda x: (-count[x], x))
            if count[b] >= 10 * count[w]:
                form[w] = b

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(links[w]), count.get(form.get(w))) for w, n in count.items())


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.fixture(scope="module")
def count():
    rnd = random.Random(1)
    out = {}
    for _ in range(120):
        w = "".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(7, 9)))
        out[w] = rnd.choice([2, 30, 400, 5000])
        for _ in range(8):
            k, c = rnd.randrange(len(w)), rnd.choice("abcéÿ")
            v = rnd.choice([w[:k] + w[k + 1:], w[:k] + c + w[k:], w[:k] + c + w[k + 1:], "".join(rnd.sample(w, len(w)))])
            out.setdefault(v, rnd.choice([2, 3, 30, 300]))
    long = "abcdefgh" * 5000
    out |= {long: 50, long[:777] + long[778:]: 5, long[:9] + "x" + long[10:]: 5, "a" * 300: 9, "a" * 301: 90}
    return out


def test_equals_brute_force(spark, count):
    df = spark.createDataFrame(list(count.items()), "word string, n long")
    want = brute({w: n for w, n in count.items() if len(w) < 1000})
    assert [r for r in got(sp.group(df)) if len(r[0]) < 1000] == want
    # many leaves: each pair is still met once
    cut = got(sp.group(df.repartition(5), leaf=12, sample=300))
    assert [r for r in cut if len(r[0]) < 1000] == want
    assert sorted(r[4] for r in cut if len(r[0]) > 1000) == [1, 1, 2]


def test_trees(count):
    ws = sorted(w for w in count if len(w) == 8)
    c = sp.codes(ws)
    bits = sp.unary(c)
    tree = sp.top(bits, 16)
    assert sum(k < 0 for k, _, _ in tree) > 8
    home = {}
    for leaf, rows in sp.leaves_in_reach(tree, bits, True):
        home.update({r: leaf for r in rows.tolist()})
    assert len(home) == len(ws)
    reach = {(leaf, r) for leaf, rows in sp.leaves_in_reach(tree, bits, False) for r in rows.tolist()}
    for i, a in enumerate(ws):
        assert {home[j] for j, b in enumerate(ws) if near(a, b)} <= {leaf for leaf, r in reach if r == i}
    i, j = sp.near_pairs(bits, c, bits, c)
    assert sorted(zip(i.tolist(), j.tolist())) == [(a, b) for a in range(len(ws)) for b in range(len(ws)) if near(ws[a], ws[b])]
    assert not np.bitwise_count(sp.unary(sp.codes(["aaaaaaa"])) ^ sp.unary(sp.codes(["aaaaaaa"]))).any()


def test_words_of_documents(spark, odd, none):
    import re
    import zlib
    rows = odd.collect()
    want = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            word = run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run
            want[word] += len(word) >= 7
    want = {w: n for w, n in want.items() if n >= 2}
    assert {r.word: r.n for r in sp.words(odd).collect()} == want
    assert {r.word: r.n for r in sp.words(odd.withColumn("word", F.lit("x")).withColumn("n", F.lit("x"))).collect()} == want
    assert sp.group(sp.words(none)).count() == 0
    upper = spark.createDataFrame([(1, "ÉCOLIERS ÉCOLIERS")], "doc_id long, text string")
    assert {w[0] for w in {r.word for r in sp.words(upper).collect()}} == {"É"}
