"""Language ID, leaks, licences, and the pipeline."""

import re
import zlib

import numpy as np
import pytest

pytest.importorskip("catchment.llm")
from catchment.llm import decontaminate, langid, license
from tests.llm.conftest import TEXTS


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def network(docs):
    return langid.fit(docs)


def test_gradients():
    r = np.random.default_rng(0)
    net = langid.Network.new(["a", "b"], 3, 1)
    for w in (*net.table, *net.recurrent):
        w[:] = w.astype(np.float32)
    steps, real = r.integers(0, 256, (langid.STRETCH, 4)), np.ones((langid.STRETCH, 4), np.float32)
    real[5:, 1] = 0
    target = np.array([0, 1, 1, 0])
    _, grads = langid._gradients(net, steps, real, target)
    for w, g in zip(net.parameters(), grads):
        for _ in range(3):
            k = np.unravel_index(np.abs(g).argmax() if _ == 0 else r.integers(g.size), g.shape)
            old = w[k]
            w[k] = old + 1e-2
            up, _g = langid._gradients(net, steps, real, target)
            w[k] = old - 1e-2
            down, _g = langid._gradients(net, steps, real, target)
            w[k] = old
            assert abs((up - down) / 2e-2 - g[k]) < 2e-3


def test_held_out_accuracy(docs, network):
    held = [(r["text"], r["lang"]) for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    found, _, foreign = langid.judged(network, [x for x, _ in held])
    assert np.mean([a == lang for a, (_, lang) in zip(found, held)]) > 0.985
    assert max(foreign) < langid.FOREIGN_AT
    short = [(a, lang) for a, (x, lang) in zip(found, held) if len(x) < 60]
    assert not short or np.mean([a == b for a, b in short]) > 0.8


def test_text_in_no_language(spark, network, odd_docs):
    junk = ["3f2a9c77 be01d4d4 00ffab12", "Это русский текст о погоде и реке.", "これは日本語の文です", "QmFzZTY0IGVuY29kZWQgdGV4dA==", "asdkjh qwlkej zxmcnb asldkj qwpz", *(x.decode("utf8", "ignore") for x in langid.noise(40, 300, 99))]
    _, _, foreign = langid.judged(network, junk)
    assert min(foreign) > langid.FOREIGN_AT
    table = spark.createDataFrame([(k, x, "s", "l") for k, x in enumerate([*junk, None, "", "12 34"])], "doc_id long, text string, score string, lang_pred string")
    assert langid.in_languages(table, network).count() == 0
    rows = [(1, "the thing and that is with the other of these", 1), (2, "der und die das nicht mit einer von", 2), (3, "la de los que en el con una por", 3)]
    clean = spark.createDataFrame(rows, "doc_id long, text string, foreign int")
    assert sorted(map(tuple, langid.in_languages(clean, network).collect())) == rows
    assert [r["doc_id"] for r in langid.in_languages(clean, network, ["de"]).collect()] == [2]
    assert langid.in_languages(odd_docs, network).columns == odd_docs.columns


def test_context_over_stretches(network):
    """Labels near the cut of a stretch differ little from those of the whole text read at once."""
    text = ("the thing and that is with the other of these. " * 40).encode()
    whole, _ = langid._run(network, 0, np.frombuffer(text, np.uint8)[:, None])
    back, _ = langid._run(network, 1, np.frombuffer(text[::-1], np.uint8)[:, None])
    p = langid._probabilities(network, whole, back[::-1])[:, :, 0].mean(0)
    assert np.abs(langid.predict(network, [text])[0][:-1] - p[:-1]).max() < 0.02


def test_no_held_out_text_in_training(spark, docs):
    texts, _ = langid.training_rows(docs)
    held = {r["text"].encode() for r in docs.where(langid.held_out(docs.doc_id)).collect()}
    kept = {r["text"].encode() for r in docs.where(~langid.held_out(docs.doc_id)).collect()}
    assert texts and all(x not in held or x in kept for x in texts)


def test_languages_of_odd_documents(odd_docs, no_docs, network):
    got = langid.identify(odd_docs, network)
    assert got.columns == ["doc_id", "text", "decoded", "n_tokens", "lang_pred", "score", "foreign"]
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert all(by[k] == ("und", 0.0) for k in (1, 2, 3, 4, 9)) and by[7][0] in network.labels and 0 <= by[6][1] <= 1
    assert got.count() == len(TEXTS) and langid.identify(no_docs, network).count() == 0
    empty = langid.fit(no_docs)
    assert {r["lang_pred"] for r in langid.identify(odd_docs, empty).collect()} == {"und"}


def test_prediction_is_independent_of_neighbours(network):
    texts = [b"the thing and one", b"\xc3\xa9tait une", b"x" * 1000, b"", b"der und die " * 30]
    together = langid.predict(network, texts)
    for x, p in zip(texts, together):
        assert len(p) == len(network.labels) + 1
        assert np.allclose(langid.predict(network, [x])[0], p, atol=1e-5)


def naive_tiles(item, text, width):
    """Greedy string tiling by trying every pair of places."""
    used_i, used_t, total = set(), set(), 0
    while True:
        best = None
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and p + n not in used_i and t + n not in used_t:
                    n += 1
                if n >= width and (best is None or (-n, p, t) < best):
                    best = (-n, p, t)
        if best is None:
            return total
        n, p, t = best
        used_i.update(range(p, p - n))
        used_t.update(range(t, t - n))
        total -= n


def test_tiling_against_brute_force():
    r = np.random.default_rng(4)
    for _ in range(60):
        item = [str(x) for x in r.integers(0, 6, r.integers(1, 40))]
        parts = [item[k : k + 9] for k in range(0, len(item), 9)]
        r.shuffle(parts)
        text = [str(x) for x in r.integers(0, 6, 20)] + [w for p in parts for w in p] + [str(x) for x in r.integers(0, 6, 20)]
        width = min(5, len(item))
        found = decontaminate.Items([(1, " ".join(item))]).leaks(" ".join(text), 0.0)
        assert (found[0][1] if found else 0) == naive_tiles(item, text, width)


def test_leaks(spark, odd_docs, no_docs):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    turned = "lambda junk " + " ".join(passage.upper().split()[6:]) + "!! more words, " + "*** ".join(passage.split()[:6])
    bench = spark.createDataFrame([(1, passage, "x"), (1, passage, "x"), (2, None, "x"), (3, "", "x"), (4, "two words", "x")], "item_id long, text string, doc_id string")
    docs = spark.createDataFrame([(10, turned), (11, " ".join(passage.split()[:5])), (12, None), (13, "only two words here"), (10, turned)], "doc_id long, text string")
    for size in (1 << 24, 30):  # broadcast, and joined
        got = sorted((r["doc_id"], r["item_id"], r["coverage"]) for r in decontaminate.leaks(docs, bench, block_bytes=size).collect())
        assert got == [(10, 1, 1.0)] * 4 + [(13, 4, 1.0)]
        assert sorted(r["doc_id"] for r in decontaminate.without_leaks(docs, bench, block_bytes=size).collect()) == [11, 12]
        assert decontaminate.leaks(odd_docs, bench, block_bytes=size).count() == 0 and decontaminate.leaks(no_docs, bench, block_bytes=size).count() == 0
        assert decontaminate.leaks(docs, bench.limit(0), block_bytes=size).count() == 0
        assert decontaminate.without_leaks(odd_docs, bench, block_bytes=size).columns == odd_docs.columns
        assert decontaminate.without_leaks(odd_docs, bench, block_bytes=size).count() == len(TEXTS)


def test_joined_leaks_equal_broadcast_ones(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    both = [sorted(map(tuple, decontaminate.leaks(docs, bench, block_bytes=size).collect())) for size in (1 << 24, 0)]
    assert both[0] == both[1] and len(both[0]) > 5


def test_licences(spark, docs, odd_docs, no_docs):
    model = license.train(license.background(docs))
    got = {(r["doc_id"], r["paragraph"]): r for r in license.scan(docs, model).collect()}
    want = {}
    for r in docs.collect():
        for k, line in enumerate(r["text"].split("\n")):
            if m := re.search(r"Apache License|MIT License|General Public License|CC BY-NC", line):
                want[r["doc_id"], k] = {"Apache License": "Apache", "MIT License": "MIT", "General Public License": "GPL", "CC BY-NC": "CC-BY-NC"}[m[0]]
    assert {k: got[k]["family"] for k in want} == want and all(got[k]["confirmed"] for k in want)
    rest = [r["family"] for k, r in got.items() if k not in want]
    assert all(x in ("proprietary", "unknown") for x in rest)
    assert model.judge("Licensed under the Eclipse Public License 2.0.")[0] == license.UNKNOWN
    assert license.scan(odd_docs, model).count() == 0 and license.scan(no_docs, model).count() == 0
    assert license.train([]).judge("Released under the MIT License.")[0] == "MIT"


def test_licence_calibration(docs):
    """On frames, unknown licences and corpus paragraphs that training did not see."""
    background = license.background(docs)
    model = license.train(background)
    paragraphs, classes, held = license.examples(background)
    own = [(x, c) for x, c, h in zip(paragraphs, classes, held) if h]
    assert license.calibration_error(model, [x for x, _ in own], [c for _, c in own]) < 0.05
    found = [(x[0] if (x := model.judge(p)) else license.NONE) for p, _ in own]
    assert np.mean([a == c for a, (_, c) in zip(found, own)]) > 0.95
    assert not [p for (p, c), a in zip(own, found) if c == license.NONE and a != c]


def test_licence_scan_against_every_line(docs):
    """Lines of at most 40 words: the scan finds what judging every single line finds.

    A statement holds a word pair of the templates, or is a single word of them; no line of the table without one names a licence.
    """
    model = license.train(license.background(docs))
    gated = lambda t: bool(set(zip(t, t[1:])) & set(model.features)) or (len(t) == 1 and (t[0],) in model.features)
    for r in docs.collect():
        lines = [license.words(x) for x in r["text"].split("\n")]
        judged = {k for k, t in enumerate(lines) if t and len(t) <= 40 and model.judge_words(t)}
        want = {k for k in judged if gated(lines[k])}
        assert not any({"license", "licence", "cc", "rights"} & set(lines[k]) for k in judged - want)
        got = {k for k, *_ in model.statements(r["text"])}
        assert want <= got and all(len(lines[k]) > 40 or k in want or model._seams(lines) for k in got)


def test_licence_texts():
    model = license.train([])
    for family, texts in license.NOTICES.items():
        for text in texts:
            found = model.statements(text)
            # The three GNU licences share the end of their notice.
            siblings = {"GPL", "LGPL", "AGPL"} if family in ("LGPL", "AGPL") else set()
            assert {x[2] for x in found} <= {family, license.UNKNOWN} | siblings and any(x[2] == family and x[5] for x in found), (family, text, found)
    wrapped = license.NOTICES["MIT"][0].replace("charge, to", "charge,\nto").replace("without limitation", "without\nlimitation")
    assert {x[2] for x in model.statements(wrapped)} == {"MIT"}


def test_license_long_lines_and_wrapped_notices():
    model = license.train([])
    filler = " ".join(["water flows down the old river to the quiet sea"] * 12)
    line = f"{filler} Released under the MIT License. {filler} Licensed under the Apache License, Version 2.0. {filler}"
    got = model.statements(line)
    assert [x[2] for x in got] == ["MIT", "Apache"] and all(x[0] == 0 and x[5] for x in got) and 60 < got[0][1] < 121 < got[1][1]
    for notice, family in (("it under the terms of the GNU General\nPublic License as published by the Free Software\nFoundation", "GPL"), ("Licensed under the GNU Affero\nGeneral Public License, version 3", "AGPL")):
        assert [(x[2], x[5]) for x in model.statements(f"Some words here\n\n{notice}\n\nmore words")] == [(family, True)]
    assert [x[2] for x in model.statements("Released under the MIT License.\nLicensed under the Apache License, Version 2.0.")] == ["MIT", "Apache"]


def test_all_licence_families_of_a_window():
    model = license.train([])
    families = lambda text: {x[2] for x in model.statements(text)}
    assert families("dual-licensed under the MIT License or the Apache License, Version 2.0") == {"MIT", "Apache"}
    assert families("either of Apache License, Version 2.0 or MIT license") == {"MIT", "Apache"}
    assert families("triple licensed: MPL-2.0, the GNU General Public License, version 2 or LGPL-2.1") == {"MPL", "GPL", "LGPL"}
    filler = " ".join(["water flows down the old river to the quiet sea"] * 12)
    got = model.statements(f"{filler} code under the ISC License and pictures under CC BY-SA 4.0. {filler}")
    assert sorted(x[2] for x in got) == ["CC-BY-SA", "ISC"] and all(x[5] for x in got)
    # One name is one family, in whatever frame.
    for family, names in license.FAMILIES.items():
        for name in names:
            for frame in license.FRAMES:
                assert families(frame.format(name)) <= {family, license.UNKNOWN}, (frame, name)
    # Every two families, named side by side.
    pairs = [(a, b) for a in license.FAMILIES for b in license.FAMILIES if a != b]
    found = [families(f"Code under the {license.FAMILIES[a][0]}, text under the {license.FAMILIES[b][0]}.") for a, b in pairs]
    assert np.mean([{a, b} <= f for (a, b), f in zip(pairs, found)]) > 0.9
    assert np.mean([f <= {a, b} for (a, b), f in zip(pairs, found)]) > 0.95


def test_long_licence_lines_against_every_window(docs):
    """Of long lines, the families found are those of all windows; unknown ones may lie at the edge of a known one."""
    model = license.train(license.background(docs))
    names = [n for names in license.FAMILIES.values() for n in names]
    found = []
    for k, r in enumerate(docs.orderBy("doc_id").limit(60).collect()):
        words = license.words((r["text"] or "").replace("\n", " "))
        tokens = [*words[:70], *license.words(names[k % len(names)]), *words[70 : 70 + 3 * k], *license.words(names[-1 - k % 7]), *words[70 + 3 * k :]]
        if len(tokens) > 40:
            want = {x[0] for i in range(0, len(tokens) - 20, 20) for x in model.judge_all(tokens[i : i + 40])} - {license.UNKNOWN}
            assert {x[1] for x in model._runs(tokens)} - {license.UNKNOWN} == want
            found.append(bool(want))
    # A bare name amid other words isn't always a statement to the model.
    assert np.mean(found) > 0.9


def test_pipeline(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    from tests.llm.test_near_duplicates import brute_fingerprint, brute_groups

    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r["doc_id"]: r for r in pipeline.run(spark, folder).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in table.collect())
    label = brute_groups([brute_fingerprint(x) for _, x in rows])
    kept = [rows[k] for k in range(len(rows)) if label[k] == k]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    words = lambda x: re.findall(r"\w+", x.lower())
    clean = [k for k, x in kept if all(naive_share(words(i), words(x)) < 0.5 for _, i in items)]
    assert sorted(got) == clean
    names = table.columns
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, table.limit(0), folder).columns == names


def test_pipeline_near_duplicates_of_odd_rows(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue black white grey")
    rows = [(1, a, "x"), (2, b, "x"), (2, a, "x"), (2, b, "x"), (3, b, "y"), (None, a, "x"), (None, c, "x"), (None, c, "x"), (4, None, "x"), (5, "", "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    got = sorted(map(str, map(tuple, pipeline.near_duplicate_stage(spark, table, "").collect())))
    assert got == sorted(map(str, [(1, a, "x"), (2, b, "x"), (None, c, "x"), (4, None, "x")]))


def naive_share(item, text):
    runs = {tuple(text[k : k + 5]) for k in range(len(text) - 4)}
    if not any(tuple(item[k : k + 5]) in runs for k in range(len(item) - 4)):
        return 0.0
    return naive_tiles(item, text, min(5, len(item))) / len(item)
