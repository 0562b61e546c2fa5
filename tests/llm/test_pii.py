import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from tallyspark.llm import pii

RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def check(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 12 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def slow(text):
    found = [(m.start(), k, m.end()) for k, (name, r) in enumerate(RAW.items()) for m in re.finditer(r, text or "") if check(name, m[0])]
    return sorted(found)


@pytest.mark.parametrize("seed", range(6))
def test_base_spans_against_the_patterns(seed):
    rng = random.Random(seed)
    bits = ["a@b.c", "@", ".", "1.2.3.4", "999.1.1.1", "0000001.2.3.255", "4111111111111111", "4111 1111-1111 1111", "+1 (988) 555-2485", "+", " ", "-", "x", "é", "😀", "12", "(", ")", "%", "\n", "a.b-c", "0"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(text) == slow(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "a@b." * 50_000, "+1 " + " " * 200_000):
        pii.base_spans(text)


def corpus():
    rng = random.Random(2)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(150)]
    for i in range(12):
        rows.append((500 + i, f"{rng.choice(words)} the redhaired plumber bob@x.org lives {rng.choice(words)} 10.0.0.{i} {rng.choice(words)}"))
    return rows + [(600, None), (601, ""), (602, "é😀 call +1 (988) 555-2485 now"), (602, "é😀 call +1 (988) 555-2485 now")]


def slow_spans(rows, disclosure=0.8, least=2):
    base = [slow(t) for _, t in rows]
    ctx, both, n_e, n_t = [], defaultdict(set), defaultdict(set), defaultdict(set)
    for d, (_, t) in enumerate(rows):
        own = []
        for w in re.findall(r"[^\W\d_]{3,}", (t or "").lower()):
            n_t[w].add(d)
        for s, k, e in base[d]:
            value = (k, t[s:e].lower() if k < 2 else re.sub("[^0-9]", "", t[s:e]))
            n_e[value].add(d)
            for m in re.finditer(r"[^\W\d_]{3,}", t):
                if m.start() >= s - 64 and m.end() <= e + 64 and not any(m.start() < y and x < m.end() for x, _, y in base[d]):
                    own.append((value, m[0].lower(), m.start(), m.end()))
                    both[value, m[0].lower()].add(d)
        ctx.append(own)
    out = []
    for d, (i, _) in enumerate(rows):
        spans = set(base[d])
        for e, w, a, b in ctx[d]:
            j, n = len(both[e, w]), len(rows)
            if j >= least and math.log(n * j / (len(n_t[w]) * len(n_e[e]))) >= disclosure * math.log(n / len(n_e[e])):
                spans.add((a, 4, b))
        names = (*RAW, "term")
        text = lambda x: ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(x))
        out.append((i, *[sum(k == n for _, k, _ in base[d]) for n in range(4)], hashlib.sha256(text(base[d]).encode()).hexdigest(), text(spans)))
    return sorted(out)


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, spans int, tkey string")
    got = sorted(map(tuple, pii.digest(docs).collect()))
    assert got == slow_spans(rows)
    assert any("term:" in r[-1] for r in got)


def test_sanitised_texts(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in corpus()], "doc_id long, text string, spans int, tkey string")
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    by = {r.doc_id: r.text for r in out.collect()}
    assert by[600] is None and by[601] == "" and by[602] == "é😀 [TERM] [PHONE] [TERM]"
    assert "bob" not in by[500] and "[EMAIL]" in by[500] and "[IP]" in by[500] and "plumber" not in by[500]
    assert all(by[i] == t for i, t in corpus() if i < 500)


def test_edges(spark):
    assert pii.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = pii.digest(spark.createDataFrame([(None, "a@b.c")], "doc_id long, text string")).collect()
    assert one[0].spans == "email:0:5"


def test_terms_at_any_distance(spark):
    far = " filler" * 40
    rows = [(i, f"plain words number {'abcdefghij'[i % 10] * 4} only") for i in range(100)]
    rows += [(200, f"zebrafish{far} bob@x.org{far} Zebrafish"), (201, f"bob@x.org zebrafish{far} end"), (202, f"zebrafish{far} end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by = {r.doc_id: r.text for r in pii.sanitise(docs, disclosure=0.7).collect()}
    assert by[200].startswith("[TERM]") and by[200].endswith("[NAME]") and "zebrafish" not in by[200].lower()
    assert "zebrafish" not in by[201] and by[202] == rows[-1][1]
    assert next(r.spans for r in pii.digest(docs, disclosure=0.7).collect() if r.doc_id == 200).startswith("term:0:9,")
