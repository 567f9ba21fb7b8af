"""The label model of personal data against a slow version, and what it accepts among planted and decoy cases."""

import math
import random

from test_edges import base_spans, docs

from tessera.llm import pii


def slow_em(rows, rounds=60):
    """EM over rows (kind, votes, base), one by one."""
    post = [1.0 if b else 0.3 if "0" in v else 0.9 for _, v, b in rows]
    for _ in range(rounds):
        new = list(post)
        for kind in {r[0] for r in rows}:
            own = [i for i, r in enumerate(rows) if r[0] == kind]
            n = {y: 1 + sum(post[i] if y else 1 - post[i] for i in own) for y in (0, 1)}
            free = [i for i in own if not rows[i][2]]
            prior = (1 + sum(post[i] for i in free)) / (2 + len(free))

            def rate(j, y, v):
                seen = sum((post[i] if y else 1 - post[i]) for i in own if rows[i][1][j] == v)
                return (seen + (3 if (v == "1") == bool(y) and v != "-" else 1)) / (n[y] + 5)

            for i in free:
                odds = prior / (1 - prior) * math.prod(rate(j, 1, v) / rate(j, 0, v) for j, v in enumerate(rows[i][1]))
                new[i] = 1 / (1 + 1 / max(math.exp(-30), min(math.exp(30), odds)))
        if max(abs(a - b) for a, b in zip(new, post)) < 1e-7:
            return new
        post = new
    return post


def test_em_equals_a_slow_version():
    rng, m = random.Random(5), len(pii.LABELERS)
    kinds = [(k, "".join(rng.choice("01-") for _ in range(m))) for k in ("card", "secret", "phone") for _ in range(5)]
    rows = [(*rng.choice(kinds), rng.random() < 0.3) for _ in range(200)]
    rows = [(k, v, b and k != "secret") for k, v, b in rows]
    counts = {}
    for r in rows:
        counts[r] = counts.get(r, 0) + 1
    fast = pii.em(counts)
    for r, p in zip(rows, slow_em(rows)):
        assert abs(fast[r] - p) < 1e-6


def test_secrets_are_found_and_decoys_are_not(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(200)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows, want, decoys = [], {}, set()
    for i in range(60):
        t, s = f"é {say(9)} ", hexa(40)
        rows.append((i, f'{t}token = "{s}" {say(5)}'))
        want[i] = f"secret:{len(t) + 9}:{len(t) + 49}"
    for i in range(100, 140):
        rows.append((i, f"{say(9)} {rng.choice(['commit', 'sha1:', 'md5'])} {hexa(40)} {say(5)}"))
        decoys.add(i)
    for i in range(200, 230):
        bad = next(x for x in iter(lambda: str(rng.randrange(10**15, 10**16)), None) if not base_spans(x))
        rows.append((i, f"{say(9)} {bad} {say(5)}"))
        decoys.add(i)
    for i in range(300, 330):
        rows.append((i, f"{say(9)} +1 (017) 555-77{rng.randint(10, 99)} {say(5)} and part-number_{rng.randint(10**6, 10**7)}-left"))
    got = {r.doc_id: r for r in pii.detect(docs(spark, rows)).collect()}
    assert {i: got[i].spans for i in want} == want
    assert {got[i].spans for i in decoys} == {""}
    assert all(got[i].spans == ",".join(base_spans(t)) for i, t in rows if i >= 300)
    texts = {r.doc_id: r.text for r in pii.redact(docs(spark, rows)).collect()}
    assert all("[SECRET]" in texts[i] for i in want) and not any("[" in texts[i] for i in decoys)


def test_very_long_runs_and_clashing_columns(spark):
    long = "a1" * 200_000
    df = docs(spark, [(1, long), (2, f'key = "{long}"'), (None, "x"), (3, None), (3, "")])
    got = {r.doc_id: r.spans for r in pii.detect(df).collect()}
    assert len(got) == 4 and got[3] == ""
    assert pii.redact(df).columns == df.columns
