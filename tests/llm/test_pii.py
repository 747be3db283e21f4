"""Personal data: base spans against the plain patterns over whole texts, contexts against a version in Python."""

import hashlib
import math
import re

import numpy as np
import pytest

pytest.importorskip("catchment.llm")
from catchment.llm import pii
from tests.llm.conftest import TEXTS


def luhn(digits):
    return sum((int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10))) for k, c in enumerate(reversed(digits))) % 10 == 0


def digits(text):
    return re.sub("[^0-9]", "", text)


#: The patterns as they are stated, over whole texts.
PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
}


def base(text):
    found = [(m.start(), n, m.end()) for n, (p, good) in enumerate(PLAIN.values()) for m in re.finditer(p, text or "", re.ASCII) if good(m[0])]
    return sorted(found)


def named(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def contexts(before, after):
    plain = lambda t: re.sub(r"\s+", " ", re.sub("[0-9]", "0", t), flags=re.ASCII).lower()
    left, right = plain(before[-60:]), plain(after[:60])
    one, two = re.search(r"(\S++ ?)$", left), re.search(r"(\S+ \S+ ?)$", left)
    next_one, next_two = re.search(r"^( ?\S++)", right), re.search(r"^( ?\S+ \S++)", right)
    out = [f"before:{one[1]}"] if one else []
    out += [f"before2:{two[1]}"] if two else []
    out += [f"after2:{next_two[1]}"] if next_two else []
    return out + ([f"around:{one[1]}|{next_one[1]}"] if one and next_one else [])


def brute(docs):
    """doc_id to all spans; small texts without long runs of identifiers."""
    seen, seeds, units = [], {}, []
    for key, text in docs:
        text = text or ""
        runs = list(re.finditer(pii.RUN, text, re.ASCII))
        for n, run in enumerate(runs):
            left = text[runs[n - 1].end() if n else 0 : run.start()]
            right = text[run.end() : runs[n + 1].start() if n + 1 < len(runs) else len(text)]
            inside, any_ = run[0], False
            for kind, (pattern, good) in enumerate(PLAIN.values()):
                all_ = list(re.finditer(pattern, inside, re.ASCII))
                for k, m in enumerate(all_):
                    if good(m[0]):
                        any_ = True
                        before = (left[-60:] if k == 0 else "") + inside[all_[k - 1].end() if k else 0 : m.start()]
                        after = inside[m.end() : all_[k + 1].start() if k + 1 < len(all_) else len(inside)] + (right[:60] if k == len(all_) - 1 else "")
                        name = m[0].lower()
                        seeds[name] = min(kind, seeds.get(name, 9))
                        seen.append((name, contexts(before, after)))
            if any_:
                continue
            pieces = inside.split(" ")
            pieces = pieces if all(len(digits(p)) >= 7 for p in pieces) else [inside]
            at = 0
            for k, piece in enumerate(pieces):
                m = re.search(r"(?s)[0-9A-Za-z+(].*[0-9A-Za-z)]|[0-9A-Za-z]", piece)
                if m:
                    before = (left[-60:] if k == 0 else pieces[k - 1] + " ") + piece[: m.start()]
                    after = piece[m.end() :] + (right[:60] if k == len(pieces) - 1 else " " + pieces[k + 1])
                    start = run.start() + at + m.start()
                    seen.append((m[0].lower(), contexts(before, after)))
                    units.append((key, start, start + len(m[0]), m[0]))
                at += len(piece) + 1
    fits = {}
    for _, _, _, text in units:
        fits[text.lower()] = [k for k, (form, least, most) in enumerate(pii.FORMS.values()) if len(text) <= pii.LONGEST and re.search(form, text, re.ASCII) and least <= len(digits(text)) <= most]
    patterns = {}
    for name, found in seen:
        for p in found:
            patterns.setdefault(p, set()).add(name)
    beliefs = {}
    for _ in range(pii.ROUNDS):
        drawn = {}
        for p, names in patterns.items():
            known = [sum(seeds.get(x) == k for x in names) + sum(b for x in names if (b := beliefs.get((x, k), 0)) >= pii.BELIEVED) for k in range(4)]
            divisor = sum(known) + pii.UNKNOWN * max(len(names) - sum(known), 0) + 1
            for k in range(4):
                if known[k] >= pii.SUPPORT and known[k] / divisor >= pii.CONFIDENT:
                    for x in names:
                        if x not in seeds and k in fits.get(x, []):
                            drawn.setdefault((x, k), []).append(known[k] / divisor)
        beliefs = {key: 1 - math.prod(1 - c for c in parts) for key, parts in drawn.items()}
    known = dict(seeds)
    for (x, k), b in sorted(beliefs.items(), key=lambda i: (i[1], -i[0][1])):
        if b >= pii.BELIEVED:
            known[x] = k
    out = {key: base(text) for key, text in docs}
    for key, start, end, text in units:
        if text.lower() in known:
            out[key] = sorted(out[key] + [(start, known[text.lower()], end)])
    return out


def random_texts(n, seed):
    r = np.random.default_rng(seed)
    bits = ["a@b.c", "x.y@q-r.co.uk", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+49 30 1234", "+1", "é@ü.de", "@", "a@b.c_d@e.f", "00.000.1.0255", "+(", "12 34", "word", "\n", "\t", " ", "-", ".", "((", ")", "x", "٣", "𝟙", " ", "4012888888881881", "4012888888881881 4012888888881881", "%", "_"]
    return ["".join(r.choice(bits) + r.choice(["", " ", " ", ", "]) for _ in range(r.integers(0, 25))) for _ in range(n)]


def rows_of(spark, docs):
    table = spark.createDataFrame([(k, x, 1, "s") for k, x in docs], "doc_id long, text string, start int, kind string").repartition(4)
    return pii.personal_data(table).collect()


def test_base_spans_of_random_texts(spark):
    docs = list(enumerate(random_texts(400, 5)))
    got = {r["doc_id"]: r for r in rows_of(spark, docs)}
    assert len(got) == len(docs)
    for key, text in docs:
        want, r = base(text), got[key]
        assert r["base_sha256"] == hashlib.sha256(named(want).encode()).hexdigest(), (text, r["spans"], named(want))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(k == n for _, k, _ in want) for n in range(4)]
        assert set(named(want).split(",")) <= set(r["spans"].split(",")) | {""}
        assert r["n_added"] == len([x for x in r["spans"].split(",") if x]) - len(want)


def planted(seed=3):
    """Texts that name phones and cards by steady words, some in forms that the base patterns miss, and clean texts with other numbers."""
    r = np.random.default_rng(seed)
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "lamp", "green"]
    some = lambda n: " ".join(r.choice(words, n))
    docs = []
    for k in range(40):
        number = f"{r.integers(200, 999)}-{r.integers(1000, 9999)}"
        docs.append((k, f"{some(6)} call me on +1 ({r.integers(200, 999)}) {number} today {some(5)}"))
        docs.append((100 + k, f"{some(4)} write to {r.choice(words)}{k}@mail.example.com for {some(5)}"))
    for k in range(6):
        docs.append((200 + k, f"{some(6)} call me on 030 555 77{k}1 today {some(5)}"))
        docs.append((300 + k, f"{some(3)} write to {r.choice(words)}{k}@localhost for {some(4)}"))
    for k in range(30):
        docs.append((400 + k, f"{some(5)} item {r.integers(1000, 10**9)} of {r.integers(1, 99)} on 2021-0{k % 9 + 1}-11 {some(3)}"))
    return docs


def test_contexts_find_what_the_patterns_miss(spark):
    docs = planted() + [(k + 1000, x) for k, x in enumerate(random_texts(60, 8))]
    got = {r["doc_id"]: r for r in rows_of(spark, docs)}
    want = brute(docs)
    assert {k: r["spans"] for k, r in got.items()} == {k: named(v) for k, v in want.items()}
    assert all(got[200 + k]["n_added"] == 1 and got[200 + k]["spans"].startswith("phone:") for k in range(6))
    assert all(got[300 + k]["n_added"] == 1 and got[300 + k]["spans"].startswith("email:") for k in range(6))
    assert all(got[400 + k]["spans"] == "" for k in range(30))


def test_copies_add_no_support(spark):
    docs = [(k, "ring 030 555 7712 now or +1 (743) 555-3824 now, ring +1 (743) 555-3824") for k in range(60)]
    assert all(r["n_added"] == 0 for r in rows_of(spark, docs))


def test_odd_documents(spark, no_docs):
    got = sorted((r["doc_id"] or 0, r["spans"], r["n_email"]) for r in rows_of(spark, TEXTS))
    assert [k for k, _, _ in got] == sorted(k or 0 for k, _ in TEXTS) and all(s == "" and n == 0 for _, s, n in got)
    assert pii.personal_data(no_docs).count() == 0


def test_very_long_texts(spark):
    """Texts on which the plain patterns would take quadratic time or deep recursion, so what is expected is written out."""
    n = 40_000
    docs = [(1, "9" * 1_000_000), (2, "1 " * 100_000), (3, "a" * 1_000_000), (4, "1.2.3.4\n" * n), (5, "+1 " + "(" * 1_000_000), (6, "a@b.c\n" * n), (7, "a." * 500_000 + "@"), (8, "4111-" * 200_000), (9, "1.2.3.4 " * 5_000)]
    got = {r["doc_id"]: r for r in rows_of(spark, docs)}
    every = {4: [(8 * k, 1, 8 * k + 7) for k in range(n)], 6: [(6 * k, 0, 6 * k + 5) for k in range(n)], 9: [(8 * k, 1, 8 * k + 7) for k in range(5_000)]}
    for key, _ in docs:
        want = every.get(key, [])
        assert got[key]["base_sha256"] == hashlib.sha256(named(want).encode()).hexdigest()
        assert got[key]["n_ip"] + got[key]["n_email"] == len(want)


def test_plan_is_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    runs = pii.runs_of(docs)
    for df in (runs, pii.occurrences(runs), pii.personal_data(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
