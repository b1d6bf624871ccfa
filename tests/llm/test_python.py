"""The other operators against brute force, round trips and held-out data."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from toposim.llm import blocks, bpe, components, hosts, html_text, jaccard, merkle, packing, toxicity

MULTI = P.path("byte_bpe_multi_50k.tiktoken")


# --- HTML ---------------------------------------------------------------

def test_blocks():
    page = "<nav><a href='/x'>A</a></nav><p>one<br>two <b>three<p>four &amp; &lt;b&gt;<script>x('</p>')</script><ul><li>a<li>b</ul>tail<!-- c --> end"
    assert [b.text for b in blocks.blocks(page)] == ["A", "one two three", "four & <b>", "a", "b", "tail end"]
    assert [b.linked > 0 for b in blocks.blocks(page)][:2] == [True, False]
    assert blocks.blocks("") == [] and [b.text for b in blocks.blocks("a < b > c <")] == ["a < b > c <"]


@pytest.mark.parametrize("tag", ['<svg-icon name="x"></svg-icon>', "<select-menu>", "<math-renderer>", "<title-bar>", "<template-x>", '<svg class="i"/>', "<math />",
                                 "<object>", "<canvas id=c>", "<select>", "<svg><style/></svg>", "<svg><svg>x</svg>y</svg>", "<svg/><svg>x</svg>", "<script>a</script x>"])
def test_blocks_after_embedded_elements(tag):
    page = f"<p>one</p>{tag}<p>two</p><p>three</p>"
    assert [b.text for b in blocks.blocks(page)] == ["one", "two", "three"]
    assert [b.text for b in blocks.blocks(page + "<object>x</object><canvas>x</canvas><select>x</select><svg>x</svg>")] == ["one", "two", "three"]


def test_blocks_raw_text_to_the_end():
    for tag in ("script", "style", "textarea", "title"):
        assert [b.text for b in blocks.blocks(f"<p>one</p><{tag}>two<p>three</p>")] == ["one"]
    assert [b.text for b in blocks.blocks("<p>a <object><script>'</object>'</script>x</object>b")] == ["a b"]


def test_names_of_long_attributes():
    page = '<div {}class="comments" id="thread"><p>one</p><p>two</p></div>'
    short, long = (html_text.vectors(blocks.blocks(page.format(x))) for x in ("", "style='" + "color:red;" * 60 + "' "))
    assert (short == long).all()
    many = " ".join(f"px-{k}" for k in range(200))
    path = html_text.vectors(blocks.blocks(f'<div class="{many} sidebar">x</div>'))[0]
    assert path[zlib.crc32(b"sidebar") % html_text.PATHS] > 0


def test_labeller_on_new_pages():
    r, p, wrong, total = random.Random(4242), html_text.trained(), 0, 0
    for _ in range(150):
        v, y = html_text.labelled(html_text.sample_page(r))
        if len(y):
            got = html_text._forward(p, *html_text._batch([v]))[0][:, 0] > 0
            wrong, total = wrong + int((got != y).sum()), total + len(y)
    assert wrong / total < 0.02


def test_gradient():
    p = {k: v.astype(np.float64) for k, v in html_text._start(1).items()}
    v, y = html_text.labelled(html_text.sample_page(random.Random(1)))
    x, mask = html_text._batch([v, v[:max(1, len(v) // 2)]])
    logit, h, tf, tb = html_text._forward(p, x, mask, True)
    d = np.where(mask, 1.0, 0)  # of the sum of logits
    dz, du = html_text._back((d[:, :, None] * p["v"])[:, :, :html_text.HIDDEN], tf, p["uf"])
    eps, i, j = 1e-3, 3, 7
    q = {**p, "uf": p["uf"].copy()}
    q["uf"][i, j] += eps
    up = np.where(mask, html_text._forward(q, x, mask)[0], 0).sum()
    q["uf"][i, j] -= 2 * eps
    down = np.where(mask, html_text._forward(q, x, mask)[0], 0).sum()
    assert abs((up - down) / (2 * eps) - du[i, j]) < 1e-2


def test_extract(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<html><nav><a href=1>Home</a></nav><article><h1>T</h1><p>Some text, here.</p></article><footer>&copy; x</footer>")],
                                  "page_id long, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got == {1: "", 2: "", 3: "T\n\nSome text, here."}
    assert html_text.extract(pages.where("false")).count() == 0


# --- BPE ----------------------------------------------------------------

@pytest.fixture(scope="module")
def tik():
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Encoder(MULTI, P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\tab'sé1!中😀\xa0\x1c"), max_size=60), min_size=1, max_size=4))
def test_bpe_equals_the_library(tik, texts):
    lib, own = tik
    for t, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(t)
        assert bpe.decoded(ids, own.vocabulary) == t.encode()


def test_bpe_long_pre_tokens(tik):
    lib, own = tik
    r = random.Random(1)
    for t in ["a" * 5000, "".join(r.choices("abcdehilnorst", k=6000)), "ab" * 2000 + "-" * 999]:
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == lib.encode_ordinary(t)


def test_rank_queue():
    q, r = bpe.RankQueue(50_000), random.Random(2)
    put = defaultdict(list)
    for i in range(2000):
        k = r.randrange(50_000)
        q.push(k, i)
        put[k].append(i)
    got = []
    while (x := q.pop()) is not None:
        got.append(x)
    assert got == sorted(put.items())


def test_bpe_columns(odd, none):
    d = bpe.decode(bpe.encode(odd, MULTI, P.PATTERN), MULTI)
    assert all((r["text"] or "").encode() == bytes(r["decoded"]) for r in d.collect())
    assert bpe.round_trip(none, MULTI, P.PATTERN).count() == 0


# --- fingerprints -------------------------------------------------------

def test_fingerprints(odd, none):
    rows = sorted(((r["doc_id"] if r["doc_id"] is not None else -2 ** 63, r["text"] or "") for r in odd.collect()), reverse=True)
    want = []
    for (i, t), (_, n) in zip(rows, [*rows[1:], rows[0]]):
        e = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        want.append((None if i == -2 ** 63 else i, len(t), hashlib.sha256(e.encode()).hexdigest(), merkle.fingerprint(t), merkle.fingerprint(e)))
    for n in (1, 3, 50):
        got = [tuple(r)[:5] for r in merkle.fingerprints(odd, n).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert merkle.fingerprints(none).count() == 0


def test_tree_locates_edits():
    lines = [f"Paragraph {i} says a thing. It has a second sentence {i * i}.\n" for i in range(60)]
    a = merkle.fingerprint("".join(lines))
    lines[30] = "Paragraph 30 says a thing. It was rewritten here.\n"
    b = merkle.fingerprint("".join(lines))
    like, gone, new = merkle.compare(a, b)
    assert 0.95 < like < 1 and len(gone) == len(new) == 1
    assert abs(like - merkle.likeness(a, b)) < 1e-12
    assert "".join(lines)[new[0][0]:][:new[0][1]] == "It was rewritten here.\n"
    assert merkle.likeness(a, a) == 1 and merkle.likeness(a, merkle.fingerprint("x")) == 0
    assert merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("")) == 1


# --- toxicity -----------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.sampled_from([0.5, 1.0, 2.0, 3.5])), max_size=12))
def test_best_segment(gaps):
    hits, at = [], -1
    for gap, s in gaps:
        at += gap + 1
        hits.append((at, s))
    cost = 0.4
    dense = [-cost] * (at + 1)
    for i, s in hits:
        dense[i] = s
    best = max((sum(dense[i:j + 1]) for i in range(len(dense)) for j in range(i, len(dense))), default=0)
    segs = toxicity.segments(hits, cost)
    assert abs(max((s for *_, s in segs), default=0) - best) < 1e-9
    for a, b, s in segs:
        assert abs(sum(dense[a:b + 1]) - s) < 1e-9
    assert all(x[1] < y[0] for x, y in zip(segs, segs[1:]))


def test_toxicity_learns(spark, odd, none):
    r = random.Random(3)
    words = ["".join(r.choices("abcdefgh", k=4)) for _ in range(300)]
    bad = ["vile", "gross", "nasty", "awful"]
    rows = []
    for i in range(600):
        t = r.choices(words, k=60)
        if i % 3 == 0:
            for k in r.sample(range(60), 4):
                t[k] = r.choice(bad)
        rows.append((i, " ".join(t), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df.select("doc_id", "toxic"))
    got = toxicity.score(df, model).where(toxicity.held_out(F.col("doc_id"))).select("toxic", "toxicity.*").collect()
    right = sum((x["score"] >= 0.5) == bool(x["toxic"]) for x in got)
    assert right / len(got) > 0.95
    assert any(x["passages"] for x in got if x["toxic"])
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(none, model).count() == 0
    assert all(x["toxicity"]["score"] == 0 for x in toxicity.score(odd, toxicity.fit(odd, df.where("false").select("doc_id", "toxic"))).collect())
    assert [x[0] for x in spark.createDataFrame([(i,) for i in range(20)], "doc_id long").select(toxicity.held_out(F.col("doc_id"))).collect()] == [
        zlib.crc32(str(i).encode()) % 5 == 0 for i in range(20)]


# --- near duplicates ----------------------------------------------------

def brute(texts):
    def shingles(x):
        w = (x or "").encode().lower().split()
        return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j]:
                o = len(sets[i] & sets[j])
                if 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                    a, b = sorted((root(i), root(j)))
                    up[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = r.choices(words, k=60)
    texts = {}
    for i in range(160):
        k = r.random()
        if k < 0.5 and texts:
            w = (texts[r.choice(list(texts))] or "x").split()
            for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
                w[r.randrange(len(w))] = r.choice(words)
        else:
            w = r.choices(words, k=r.choice([1, 4, 5, 6, 30, 80, 150]))
            if r.random() < 0.5:
                w = passage + w
        texts[i] = " ".join(w).upper() if r.random() < 0.1 else " ".join(w)
    texts[200], texts[201], texts[202] = None, "", " \n\x0b"
    return texts


@pytest.mark.parametrize("seed,block", [(1, 1000), (2, 3)])
def test_jaccard_components(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "QUERIES", 7)
    texts = corpus(seed)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("id", F.lit(2))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link(df).collect()}
    assert got == brute(texts)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {c for _, c in got.values()}


def test_divide_skip_equals_counting():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 90, 60).astype(np.uint64)) for _ in range(40)]
    sets += [np.unique(np.concatenate((s[:-3], r.integers(0, 90, 3).astype(np.uint64)))) for s in sets[:20]]
    index = jaccard.Index(sets)
    for q in sets:
        want = [k for k, s in enumerate(sets) if jaccard.links(len(np.intersect1d(q, s)), len(q), len(s))]
        assert sorted(index.search(q)) == want


def test_words_across_parts(monkeypatch):
    text = " ".join(f"word{i}\t" for i in range(500)) + "x" * 700
    whole = jaccard.shingle_sets([text, "", "A b"])
    cut = jaccard._cut
    monkeypatch.setattr(jaccard, "_cut", lambda raw: cut(raw, 64))
    assert all((a == b).all() for a, b in zip(whole, jaccard.shingle_sets([text, "", "A b"])))


def test_jaccard_odd_rows(odd, none):
    got = jaccard.link(odd).collect()
    assert len(got) == odd.count() and jaccard.link(none).count() == 0
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}


def test_components(spark):
    r = random.Random(7)
    edges = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(500, 499)]
    df = spark.createDataFrame(edges, "a long, b long")
    up = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {x["id"]: x["component"] for x in components.connected(df).collect()}
    assert got == {k: v for k, v in up.items() if any(k in e and e[0] != e[1] for e in edges)}


# --- hosts --------------------------------------------------------------

def test_hosts(spark):
    link = "<a href='https://bad.net/x'>x</a><a HREF=\"//good.com/\">y</a>"
    rows = [(1, "https://Good.COM/en/a?b", "", "allow", "com/"), (2, "http://bad.net/es/x", "", "block", "net/es/"), (3, "http://bad.net/de/x#y", None, "block", None),
            (4, "http://spam.org/1", "<a href='http://bad.net/'>z</a>" * 5, "block", None), (5, "http://mixed.org/", link, "block", None),
            (6, None, None, "allow", None), (7, "no scheme", "", "allow", None), (8, "http://www.example.com/en/q", "", "allow", "www.example.com/en/"),
            (9, "x://a.example.com/en/", "", "block", "example.com/en/"), (10, "http://quiet.org", "", "allow", None)]
    rows += [(100 + i, f"http://site{i}.com/", "", "allow", "com/") for i in range(30)] + [(200 + i, f"http://plain{i}.org/", "", "allow", None) for i in range(30)]
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["verdict"], r["rule"]) for r in hosts.judge(df).collect()}
    assert {k: got[k] for k in got} == {r[0]: (r[3], r[4]) for r in rows}
    assert hosts.judge(df.where("false")).count() == 0


def converged(seeds, links):
    """Personalised PageRank by the linear equations."""
    names = sorted({*seeds, *(h for e in links for h in e)})
    at = {h: i for i, h in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for a, b in links:
        m[at[b], at[a]] += 1
    m = m / np.maximum(m.sum(0), 1)
    x = np.linalg.solve(np.eye(len(names)) - hosts.DAMPING * m, [(1 - hosts.DAMPING) * seeds.get(h, 0) for h in names])
    return dict(zip(names, x))


def test_hosts_at_the_end_of_a_chain(spark):
    """h30 -> ... -> h1 -> bad.net: each is that many links from the blocked."""
    chain = ["bad.net"] + [f"h{i}.org" for i in range(1, 31)]
    rows = [(0, "http://bad.net/es/x", "")] + [(i, f"http://{chain[i]}/", f"<a href='http://{chain[i - 1]}/'>x</a>") for i in range(1, 31)]
    rows += [(100 + i, f"http://plain{i}.org/", "") for i in range(1000)]
    rank = converged({"bad.net": 1}, [(a, b) for a, b in zip(chain, chain[1:])])
    score = {h: x / sum(rank.values()) * len(rows) for h, x in rank.items()}
    want = {h for h, x in score.items() if x > hosts.TAU}
    assert want == set(chain)
    got = hosts.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["host"] for r in got if r["verdict"] == "block"} == want


def test_ranks_converge(spark):
    r = random.Random(5)
    links = sorted({(f"a{r.randrange(12)}", f"a{r.randrange(12)}") for _ in range(40)} | {(f"a{i}", f"a{(i + 1) % 12}") for i in range(12)})
    want = converged({"a0": 3, "a5": 1}, links)
    edges = hosts._shares(spark.createDataFrame(links, "src string, dst string").withColumn("p", F.lit(1.0)))
    seeds = spark.createDataFrame([("a0", 3.0), ("a5", 1.0)], "host string, seed double")
    got = {x["host"]: x["rank"] for x in hosts.propagate(seeds, edges, 10, 1e-3).collect()}
    assert got.keys() == want.keys() and max(abs(got[h] - want[h]) for h in want) / 4 * 10 <= 1e-3


# --- packing ------------------------------------------------------------

@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 1024), min_size=1, max_size=120))
def test_best_fit(lengths):
    x = np.array(lengths)
    bins, offsets, fill = packing.best_fit(x)
    assert fill.max() <= 1024 and len(fill) >= packing.lower_bound(x) and len(fill) <= 1.5 * packing.lower_bound(x) + 1
    for b in range(len(fill)):
        at = 0
        for o, n in sorted(zip(offsets[bins == b], x[bins == b])):
            assert o == at
            at += n
        assert at == fill[b]


def test_lower_bound_beats_the_sum():
    assert packing.lower_bound(np.array([600] * 10)) == 10
    assert packing.lower_bound(np.array([350] * 10)) == 5


def test_packing(spark, odd, none):
    path = P.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    p = packing.pieces(odd, path)
    rows = packing.pack(p, per_partition=3).collect()
    assert len(rows) == p.count()
    want = sorted((repr(r["doc_id"]), k, s, n, zlib.crc32(np.asarray(ids[s:s + n], "<u4").tobytes())) for r in odd.collect()
                  for ids in [lib.encode(r["text"] or "", add_special_tokens=False).ids + [2]] for k, (s, n) in enumerate(packing.cut(len(ids))))
    assert sorted((repr(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    assert packing.pack(packing.pieces(none, path)).count() == 0


def test_added_tokens_in_texts(spark):
    from tokenizers import Tokenizer
    path = P.path("byte_bpe_50k.json")
    lib, tok = Tokenizer.from_file(path), packing.Tokenizer(path)
    texts = ["<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>\n\n<|endoftext|><|endoftext|>c", "<|endoftext|", "<|ENDOFTEXT|>", "x\x85<|endoftext|>", "plain", ""]
    assert [tok.encode(t).tolist() for t in texts] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in tok.encode(texts[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [(i, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())) for i, t in enumerate(texts) for ids in [lib.encode(t, add_special_tokens=False).ids + [2]]]
    assert sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in packing.pieces(docs, path).collect()) == want
