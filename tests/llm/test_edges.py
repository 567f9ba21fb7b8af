"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, langid, packing, pii, simhash, suffix, tokencount, topk, toxicity, warc

ALPHA = "the quick brown fox jumps over the lazy dog while seven wizards brew strange potions under pale moonlight near quiet rivers"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, block string, fp string, id string, found string, t string, votes string, c0 string, word string"


def docs(spark, rows):
    """Rows (doc_id, text) among columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", 1, *["x"] * 8) for i, t in rows], DOCS)


def texts(n=30, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(n)]
    return out + [out[0], out[0] + " more", "", None, "é ü ß 日本語", "x" * 100_000, " ".join(words) * 40]


def rows(spark_df):
    return sorted(map(tuple, spark_df.collect()), key=str)


# --- 1


def test_warc_round_trip(spark, tmp_path):
    pages = [(5, "http://a", "<p>x\r\n\r\nWARC/1.1 é</p>"), (3, None, "<p>x\r\n\r\nWARC/1.1 é</p>"), (1, "http://n\r\nX: 1", None), (7, "u", ""), (7, "u", ""), (9, "l", "y" * 300_000), (None, "u", "z"), (None, "v", "<p>x\r\n\r\nWARC/1.1 é</p>")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "id long, url string, payload string, digest string").drop("digest")
    idx = warc.write(df, f"file://{tmp_path}/w")
    got = warc.read(idx, payloads=True).collect()
    assert len(got) == len(pages)
    kinds = sorted((r.record_id.rpartition(":")[2], r.kind, (r.refers_to or "").rpartition(":")[2], r["size"]) for r in got)
    n = len("<p>x\r\n\r\nWARC/1.1 é</p>".encode())
    want = [("5", "revisit", "3", n), ("3", "response", "", n), ("1", "response", "", 0), ("7", "revisit", "1", 0), ("7", "revisit", "1", 0), ("9", "response", "", 300_000), ("", "response", "", 1), ("", "revisit", "3", n)]
    assert kinds == sorted(want)
    assert {bytes(r.payload) for r in got if r.kind == "response"} == {(p or "").encode() for _, _, p in pages}
    # the index of a scan agrees with the index of the writer
    files = [r.file for r in idx.select("file").distinct().collect()]
    again = warc.index(spark, files)
    assert rows(again.select("file", "offset", "length", "digest", "kind")) == rows(idx.select("file", "offset", "length", "digest", "kind"))
    some = warc.read(idx.filter("length > 500"))
    assert some.count() == idx.filter("length > 500").count()


def test_warc_empty(spark, tmp_path):
    df = spark.createDataFrame([], "id long, url string, payload string")
    assert warc.read(warc.write(df, f"file://{tmp_path}/e")).count() == 0


# --- 2

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text):
            s, d = m.group(), re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in s.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_against_brute_force(spark):
    rng = random.Random(2)
    pieces = ["a.b@c.de", "x@y", "@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "+1 (017) 555-7713", "+123", "4111 1111 1111 1111", "4111-1111-1111-1112", "12345678", "é", "日本", " ", "_", ".", "-", "%", "+", "@c.de", "9", "a", "(", ")", "a@b.c@d.e", "555 555"]
    cases = [None, "", "a" * 50_000, "1" * 50_000, "a." * 20_000 + "@b.c", "a@" + "b." * 20_000 + "c", "+1" + "2 " * 20_000, "1." * 30_000, "x@y.z " * 3000]
    cases += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    got = {r.doc_id: r for r in pii.detect(docs(spark, list(enumerate(cases)))).collect()}
    for i, t in enumerate(cases):
        want = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(s.startswith(k + ":") for s in want) for k in BASE]
        assert set(want) <= set(got[i].spans.split(","))  | ({""} if not want else set())


def test_pii_redact(spark):
    df = docs(spark, [(1, "é mail a@b.com and +1 (017) 555-7713."), (1, None), (None, ""), (2, "clean")])
    out = pii.redact(df)
    assert out.columns == df.columns and sorted("~" if r.text is None else r.text for r in out.collect()) == ["", "clean", "~", "é mail [EMAIL] and [PHONE]."]
    assert pii.detect(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).count() == 0


# --- 3


def components(fps, distance=4):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def slow_fingerprint(text, k):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    cases = dict(enumerate(texts()))
    got = simhash.groups(docs(spark, list(cases.items()) + [(0, cases[0])])).collect()
    assert len(got) == len(cases) + 1
    want = {i: slow_fingerprint(t, 4) for i, t in cases.items()}
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == want
    assert {r.doc_id: r.component for r in got} == components(want)
    assert simhash.groups(docs(spark, [])).count() == 0


def test_dense_keys_lose_no_link(spark, monkeypatch):
    rng = random.Random(3)
    centre, far = rng.getrandbits(64), rng.getrandbits(64)
    fps = {}
    for i in range(300):  # chains around two centres, far more in a key than one block takes
        x = centre if i % 2 else far
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        fps[i] = x
    signed = {i: x - (1 << 64) if x >> 63 else x for i, x in fps.items()}
    monkeypatch.setattr(simhash, "DENSE", 16)
    df = spark.createDataFrame([(v,) for v in set(signed.values())], "fp long")
    from tessera.llm.components import connected_components

    part = {r.node: r.component for r in connected_components(simhash.links(df)).collect()}
    got = {i: part.get(v, v) for i, v in signed.items()}
    want = components(fps)
    assert len(set(got.values())) == len(set(want.values()))
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in fps for j in fps)


def test_near_copies_by_similarity(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(5)) for _ in range(2000)]
    base = [[rng.choice(words) for _ in range(300)] for _ in range(12)]
    cases = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base[:6]):
        c = list(b)
        c[10 * i + 3] = "changed"
        cases += [(100 + i, " ".join(c)), (200 + i, " ".join(b))]
    cases += [(300, None), (301, ""), (302, ""), (None, "kept"), (5, " ".join(base[5]))]
    kept = [r.doc_id for r in simhash.dedup(docs(spark, cases)).collect()]
    assert sorted(x for x in kept if x is not None) == [*range(12), 300] and kept.count(None) == 1


def slow_kept(cases, similarity=0.8, words=5):
    """Ids of the smallest id of each group by brute force; ids are unique."""
    sets = {}
    for i, t in cases:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            common = len(sets[i] & sets[j])
            if i < j and common >= similarity * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i for i in sets if root(i) == i}


def test_near_copies_against_brute_force(spark, monkeypatch):
    """Appended, truncated and short copies on both sides of the limit, and more texts with common shingles than a block takes."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(5)) for _ in range(2000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    texts = [say(1), say(4), say(5)]
    for n, more in ((10, 1), (20, 1), (20, 5), (60, 10), (150, 15), (150, 30), (150, 40), (400, 90)):
        for _ in range(4):
            b = say(n)
            texts += [b, b + say(more), b[: n - more]]
    shared = say(60)
    texts += [shared + say(rng.randint(4, 20)) for _ in range(60)]
    cases = [(i, " ".join(t)) for i, t in enumerate(texts)]
    monkeypatch.setattr(simhash, "DENSE", 16)
    got = sorted(r.doc_id for r in simhash.dedup(docs(spark, cases)).collect())
    assert got == sorted(slow_kept(cases))


def test_near_copies_below_the_limit_stay(spark):
    """Texts of Jaccard similarity just below 0.8 stay, those right at it go."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(5)) for _ in range(2000)]
    cases = []
    for i in range(40):  # 80 shingles, then 80 of 100 and 80 of 101
        b = [rng.choice(words) for _ in range(84)]
        cases += [(i, " ".join(b)), (100 + i, " ".join(b + [rng.choice(words) for _ in range(20 + i % 2)]))]
    got = {r.doc_id for r in simhash.dedup(docs(spark, cases)).collect()}
    assert got == {*range(40), *range(101, 140, 2)}


def test_near_copies_go_by_text(spark):
    """Ids that several texts share don't tie them, and copies without an id go."""
    rng = random.Random(12)
    one, two, three, four = (" ".join("".join(rng.choice("abcdefghijkl") for _ in range(5)) for _ in range(60)) for _ in range(4))
    cases = [(1, one), (2, two), (2, three), (3, one + " end"), (3, four), (None, three + " end"), (None, four), (None, "alone"), (None, "alone"), (2, two)]
    got = simhash.dedup(docs(spark, cases)).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, one), (2, two), (2, three), (3, four), (None, "alone")], key=str)


# --- 4


def slow_removed(cases):
    seen, out = set(), {}
    by_id = {}
    for i, t in cases:
        by_id.setdefault(i, []).append((t or "").encode())
    for i in sorted(x for x in by_id if x is not None):
        own = set()
        for b in by_id[i]:
            gone = np.zeros(len(b), bool)
            for j in range(len(b) - 49):
                if b[j : j + 50] in seen:
                    gone[j : j + 50] = True
                own.add(b[j : j + 50])
            out.setdefault(i, []).append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
        seen |= own
    out[None] = [(len(b), 0, 0, hashlib.sha256(b).hexdigest()) for b in by_id.get(None, [])]
    return {k: sorted(v) for k, v in out.items() if v}


def test_suffix_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    base = [t for t in texts(20, 6)]
    line = ALPHA[:70]
    cases = list(enumerate(base)) + [(50, ALPHA), (51, "é" + ALPHA[30:] + "tail"), (49, line), (52, line + line), (53, " " * 500), (54, "a" + " " * 300 + "b"), (55, ALPHA[:49]), (56, "ab" * 200), (57, "ba" * 100), (50, ALPHA), (None, ALPHA), (60, "z" + line[:50]), (61, line[5:55])]
    cases += [(70 + k, "".join(rng.choice("ab") for _ in range(400))) for k in range(6)]
    got = {}
    for r in suffix.repeated(docs(spark, cases).repartition(3)).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed
    assert {k: sorted(v) for k, v in got.items()} == slow_removed(cases)
    assert suffix.repeated(docs(spark, [])).count() == 0


def test_suffix_stretches_and_packs(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 97)
    body = np.frombuffer((ALPHA * 3).encode(), np.uint8)
    whole = [(int(r.lo[i] + r.first), int(r.hi[i] + r.first)) for r in suffix.stretches(body, np.array([len(body)])) for i in range(len(r.lo))]
    assert sorted(w for lo, hi in whole for w in range(lo, hi + 1)) == list(range(len(body) - 49))


# --- 5


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(6)
    vecs = [(i, rng.normal(size=8).round(2).tolist()) for i in range(400)] + [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [1.0, 2.0]), (404, []), (405, [3e38] * 8), (7, [0.5] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in vecs], "vec_id long, embedding array<float>, label int")
    got = {}
    scaled = topk.scaled(df.filter("vec_id is null or vec_id <> 405"))
    for r in topk.topk(scaled, scaled.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ok = {}
    for r in scaled.collect():
        ok.setdefault(r.vec_id, []).append(r.vec)
    assert not set(ok) & {400, 401, 402, None}
    for q in (0, 100, 200, 300):
        want = sorted((-sum(a * b for a, b in zip(ok[q][0], v)), i) for i, vs in ok.items() if i != q for v in vs)[:10]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
    huge = topk.scaled(df.filter("vec_id in (0, 100, 405)"))
    assert topk.topk(huge, huge.filter("vec_id = 0")).count() == 2
    assert topk.topk(scaled.limit(0), scaled.limit(0)).count() == 0


# --- 6


def test_language_edges(spark):
    rng = random.Random(7)
    sides = {"en": "th sh ing er on".split(), "fr": "eau oi que re ai".split()}
    say = lambda lang, n: " ".join("".join(rng.choice(sides[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    train = spark.createDataFrame([(i, say(lang, 40), lang) for i, lang in enumerate(["en", "fr"] * 60)], "id long, text string, lang string")
    model = langid.train(train)
    cases = [(1, say("en", 30)), (2, say("fr", 30)), (2, say("fr", 3000)), (3, None), (4, ""), (5, "123 !!"), (None, say("en", 5))]
    got = sorted((str(r.id), r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(cases, "id long, text string"), model).collect())
    assert [(i, p) for i, p, _ in got] == [("1", "en"), ("2", "fr"), ("2", "fr"), ("3", "und"), ("4", "und"), ("5", "und"), ("None", "en")]
    assert all(0 <= s <= 1 for *_, s in got)
    assert langid.train(train.limit(0)) is None
    assert langid.predict(train.limit(0), model).count() == 0
    lab = langid.Labeller(*model[1:])
    words = (say("en", 25) + " " + say("fr", 25)).split()
    p = lab.probabilities(lab.number(words), np.array([50])).argmax(axis=1)
    assert (p[:25] == 0).mean() > 0.8 and (p[25:] == 1).mean() > 0.8  # code-switched text, word by word


def test_forward_backward_against_enumeration():
    import itertools

    rng = np.random.default_rng(8)
    e, t, lengths = rng.random((7, 3)), rng.random((3, 3)), np.array([4, 1, 2])
    got, at = langid.forward_backward(e, lengths, t), 0
    for n in lengths:
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            s = np.prod([e[at + i, y] for i, y in enumerate(path)]) * np.prod([t[a, b] for a, b in zip(path, path[1:])])
            for i, y in enumerate(path):
                want[i, y] += s
        assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n


# --- 7


def test_decontamination(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 6))) for _ in range(3000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([10, 20, 40, 100])))) for i in range(12)]
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (52, "too short"), (0, items[0][1]), (None, "x y z a b c d e f g")], "item_id long, text string")
    cases = [(100 + i, " ".join(say(60))) for i in range(40)]
    cases += [(i, " ".join([*say(50), t.upper() + "!", *say(30)])) for i, t in items]
    para = items[2][1].split()
    para[4] = "changed"
    cases += [(20, "\n".join(para)), (21, None), (22, ""), (23, items[1][1]), (23, items[1][1]), (None, items[3][1]), (24, " ".join(say(20_000) + items[5][1].split()))]
    df = docs(spark, cases)
    got = {(r.doc_id, r.item_id) for r in decontam.matches(df, bench).collect()}
    assert got == {(i, i) for i, _ in items} | {(20, 2), (23, 1), (None, 3), (24, 5)}
    assert got == {(r.doc_id, r.item_id) for r in decontam.matches(df, bench, part=4).collect()}
    left = decontam.clean(df, bench)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {100 + i for i in range(40)} | {21, 22}
    assert decontam.matches(df, bench.limit(0)).count() == 0 and decontam.matches(df.limit(0), bench).count() == 0 and decontam.clean(df.limit(0), bench).count() == 0


def test_short_items_are_found(spark):
    """Exact, cut and gapped copies of short items in long texts, and items under eight words by their sequence."""
    rng = random.Random(14)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 6))) for _ in range(3000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, say(2 + i % 12)) for i in range(48)]
    cases = [(1000 + i, " ".join(say(200))) for i in range(20)]
    want = set()
    for i, ws in items:
        cases.append((i, " ".join([*say(70), *ws, *say(70)])))
        want.add((i, i))
        if len(ws) >= 8:  # four in five words, others between
            kept = [w for k, w in enumerate(ws) if k % 5 != 2]
            gapped = [x for k, w in enumerate(kept) for x in ([w, *say(1)] if k % 3 == 0 else [w])]
            cases += [(100 + i, " ".join([*say(70), *kept, *say(70)])), (200 + i, " ".join([*say(70), *gapped, *say(70)]))]
            want |= {(k + i, i) for k in (100, 200) if len(kept) >= 0.8 * len(ws)}
        else:  # another order
            cases.append((300 + i, " ".join([*say(70), *reversed(ws), *say(70)])))
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.matches(docs(spark, cases), bench).collect()}
    assert want <= got
    assert not {d for d, _ in got} & {*range(1000, 1020), *range(300, 348)}


def test_lcs_of_words():
    rng = random.Random(10)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        assert decontam.lcs(a, b) == row[-1]


# --- 8


@pytest.mark.parametrize("fallback", [True, False])
def test_token_counts_against_library(fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = tokencount.vocabulary(tokencount.default_vocabulary()) if fallback else [(p, -3.0 * len(p) % 7 - 1) for p in ["<unk>", "▁", "a", "b", "ab", "ba", "aba", "▁a", "e", "日"]]
    tok = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=fallback))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    mine, rng = tokencount.Counter(pieces), random.Random(11)
    cases = ["".join(rng.choice("ab e▁é日<s>x0😀\n") for _ in range(rng.randint(0, 40))) for _ in range(500)] + [t for t in texts() if t]
    for t in cases:
        assert mine.text(t) == len(tok.encode(t, add_special_tokens=False).ids), t


def test_token_count_rows(spark):
    got = rows(tokencount.count_tokens(docs(spark, [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "x")]), tokencount.default_vocabulary()))
    assert [r[1] for r in got if r[0] in (2, 3)] == [0, 0] and len(got) == 5
    assert tokencount.count_tokens(docs(spark, []), tokencount.default_vocabulary()).count() == 0


# --- 9


def test_toxicity_edges(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    bad = ["zzgrub", "zzmuck", "zzfilk"]
    cases, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        t = [rng.choice(words) for _ in range(40)] + ([rng.choice(bad) for _ in range(3)] if toxic else [])
        rng.shuffle(t)
        cases.append((i, " ".join(t)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    cases += [(1000, None), (1001, ""), (None, "zzgrub zzmuck abc"), (1002, "you idiot, you stupid clown " * 3), (0, cases[0][1])]
    df, lab = docs(spark, cases), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = {(r.doc_id, r.score) for r in toxicity.score(df, lab).collect()}
    assert all(0 <= s <= 1 for _, s in got)
    by = dict(got)
    assert all((by[i] >= 0.5) == (i % 5 == 0) for i in range(400))
    assert by[1000] == by[1001] < 0.5 and by[None] >= 0.5 and by[1002] >= 0.5
    left = toxicity.clean(df, lab)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [*(i for i in range(400) if i % 5), 1000, 1001]
    assert toxicity.score(df.limit(0), lab).count() == 0 and toxicity.score(df, lab.limit(0)).count() == len(cases)


# --- 10


def test_packing(spark):
    from tokenizers import Tokenizer

    path, cap = packing.default_tokenizer(), 64
    cases = list(enumerate(texts())) + [(0, "again"), (None, "null id"), (90, "<|endoftext|> x <|startoftext|>"), (91, "ﬁ ², ½ a_b it's 'LL")]
    got = packing.pack(docs(spark, cases), path, cap).toPandas()
    tok = Tokenizer.from_file(path)
    want = sorted(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in cases)
    assert got.length.sum() == sum(want) and got.length.max() <= cap
    assert sorted(g.length.sum() for _, g in got[got.doc_id.isin(range(1, 90))].groupby("doc_id")) == sorted(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in cases if i not in (0, None, 90, 91))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= cap
    assert got.sequence_id.nunique() == slow_best_fit(got.length.tolist(), cap)
    assert packing.pack(docs(spark, []), path).count() == 0


def slow_best_fit(lengths, cap):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [(left, i) for i, left in enumerate(bins) if left >= n]
        if fits:
            bins[min(fits)[1]] -= n
        else:
            bins.append(cap - n)
    return len(bins)


def test_best_fit_counts_like_one_by_one():
    rng = random.Random(13)
    for _ in range(200):
        cap = rng.randint(1, 40)
        lengths = [rng.randint(1, cap) for _ in range(rng.randint(0, 120))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        plan = packing.best_fit_decreasing(counts, cap).tolist()
        used = {}
        for n in counts:
            mine = sorted(r for r in plan if r[0] == n)
            for k in range(counts[n]):
                _, first, seq, each, offset = max(r for r in mine if r[1] <= k)
                at = (seq + (k - first) // each, offset + (k - first) % each * n)
                used.setdefault(at[0], []).append((at[1], n))
        for parts in used.values():
            end = 0
            for o, n in sorted(parts):
                assert o == end
                end += n
            assert end <= cap
        assert len(used) == slow_best_fit(lengths, cap)


def test_whole_tables(spark):
    """Queries of the package over the smallest tables, by oracle where there is one."""
    import duckdb

    from tessera.llm import registry

    d, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        c.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, d)
        cols = sorted(df.columns)
        cur = c.execute(sql)
        names = [x[0] for x in cur.description]
        assert sorted(names) == cols
        assert sorted(tuple(str(r[x]) for x in cols) for r in df.collect()) == sorted(tuple(str(r[names.index(x)]) for x in cols) for r in cur.fetchall())


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    got = langid.op6_language_id(spark, d).join(lang, "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.97 * got.count()
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    tox = toxicity.op9_toxicity(spark, d).join(labels, "doc_id").filter("held_out").select(F.col("predicted") == F.col("toxic")).collect()
    assert sum(r[0] for r in tox) >= 0.9 * len(tox)
