"""Operators of tidemark.llm against brute force, hand-made cases and edge rows."""

import collections
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard_join, line_dedup, mixing, quality_rules, style_tree, suffix_tree, toxicity, transcripts, url_filter
from tidemark.llm.frames import components, table

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, row string"
UP = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One two three four five six.\nSeven eight."), (4, "One two three four five six.\nSeven eight."), (5, long), (6, long + " end"), (None, "lonely words here"), (7, "x")]
    return spark.createDataFrame([(i, t, None, "s" if i else None, 0, "k", "r") for i, t in rows], DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def brute_components(docs, width, percent):
    sets = {}
    for r in docs:
        w = words((r.text or "").translate(UP))
        n = min(width, len(w))
        sets[r.doc_id] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join_is_exact(spark, width, percent):
    base = table(spark, SF, "documents").select("doc_id", "text").collect()
    rng = np.random.default_rng(5)
    near = []
    for k, r in enumerate(base[:40]):  # near copies with a few words changed
        w = r.text.split(" ")
        for c in range(3):
            v = list(w)
            for i in rng.integers(0, len(v), max(1, len(v) // 60)):
                v[i] = f"new{c}"
            near.append((10_000 + 10 * k + c, " ".join(v)))
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in base] + near, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs, width, percent).collect()}
    assert got == brute_components(docs.collect(), width, percent)


def test_only_sets_with_enough_in_common_reach_the_regions(spark, monkeypatch):
    rng, reached = np.random.default_rng(11), []
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 10**6, 300)) for _ in range(200)]
    near = [t.replace(t.split(" ")[150], "other") for t in texts[:4]]
    docs = spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string").repartition(3)
    placed = jaccard_join.placed
    monkeypatch.setattr(jaccard_join, "placed", lambda held, *shape: reached.append(held.count()) or placed(held, *shape))
    got = {r.doc_id: r.component_id for r in jaccard_join.join(docs, 5, 80).collect()}
    assert got == {k: k - 200 if k >= 200 else k for k in range(204)}
    assert reached == [8]


def test_jaccard_join_at_exactly_the_threshold(spark):
    rng, texts = np.random.default_rng(12), []
    for _ in range(120):
        n = int(rng.integers(2, 60))
        own = [f"w{k}" for k in rng.choice(10**6, n + n, replace=False)]
        both = -(-n * 8 // 10) - int(rng.integers(0, 2))
        texts += [" ".join(own[:n]), " ".join(own[:both]), " ".join(own[n - both :][:n])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs, 1, 80).collect()}
    want = brute_components(docs.collect(), 1, 80)
    assert got == want and 120 < len({c for _, c in want.values()}) < 360


def test_shingles_in_common_are_counted_once_a_row(spark):
    rng = np.random.default_rng(13)
    cut = jaccard_join._cut(80)
    sets = {k: np.unique(np.concatenate([rng.integers(0, 400, 30) * (cut // 400), [7]])).astype(np.uint64) for k in range(2, 60)}
    sets[60] = np.array([11], np.uint64)
    rows = [(k, bytearray(v.tobytes())) for k, v in sets.items()] + [(5, bytearray(sets[5].tobytes()))]
    for parts in (1, 7):
        tested = spark.createDataFrame(rows, "node long, tested binary").repartition(parts)
        got = {r.node: r.n for r in jaccard_join.in_common(tested, 80).collect() if r.node > 1}
        times = {}
        for v in sets.values():
            for x in v.tolist():
                times[x] = times.get(x, 0) + 1
        want = {k: sum(times[x] > 1 for x in v.tolist()) * (2 if k == 5 else 1) for k, v in sets.items()}
        assert got == {k: n for k, n in want.items() if n}


def test_region_join_by_pivots_is_exact():
    rng = np.random.default_rng(2)
    seeds = [rng.choice(5000, 60, replace=False) for _ in range(12)]
    sets = [np.unique(np.concatenate([rng.choice(s, 57, replace=False), rng.integers(5000, 9000, 2)])).astype(np.uint64) for s in seeds for _ in range(12)]
    links = jaccard_join._Links(len(sets))
    jaccard_join.join_region(jaccard_join._Space(sets, 80), np.arange(len(sets)), links)
    want = jaccard_join._Links(len(sets))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                want.join(i, j)
    assert [links.find(i) == links.find(j) for i in range(len(sets)) for j in range(i)] == [want.find(i) == want.find(j) for i in range(len(sets)) for j in range(i)]


def test_line_dedup_keeps_the_first_of_each_group(spark):
    a = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark wood tonight " * 3
    texts = [(1, a + "\nHello"), (2, "hello\n\n" + a.replace("fox", "fix", 1)), (3, "Only here, quite alone."), (4, "again\nagain\nother")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_kept) for r in line_dedup.dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1] == (a + "\nHello", 2, 2)
    assert got[3] == ("Only here, quite alone.", 1, 1)
    assert got[4] == ("again\nother", 3, 2)
    assert got[2][1] == 2 and "hello" not in got[2][0]


def test_near_lines_at_exactly_the_threshold_link():
    # 20 of 100 letters changed, none beside another: similarity 0.8, and each change takes and gives two letter pairs.
    line = "abcd" * 25
    other = line.replace("b", "x", 20)
    rows = pa.table({"key": pa.array([1, 2], pa.int64()), "sim": pa.array([5, 5], pa.int64()), "line_text": [line, other]})
    assert line_dedup.distance(line, other) == 20 and line_dedup.alike(line, other)
    assert np.abs(line_dedup._grams(line) - line_dedup._grams(other)).sum() == 80
    assert line_dedup._verify(rows) == [(1, 2)]
    assert [line_dedup.edits(np.array([n]))[0] for n in range(1, 20_000)] == [n // 5 for n in range(1, 20_000)]


def test_near_lines_of_texts_without_doc_id_link(spark):
    # The same set of words, so the same SimHash.
    a = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark wood tonight " * 3
    b = a.replace("quick", "lazy quick", 1).replace("dark", "deep dark", 1)
    texts = [(None, a), (None, b + "dog"), (7, a + "fox\nalone"), (None, "alone")]
    rows = line_dedup.dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted((r.n_lines, r.n_kept) for r in rows if r.doc_id is None) == [(1, 0), (1, 0), (1, 0)]
    assert [(r.text, r.n_kept) for r in rows if r.doc_id == 7] == [(texts[2][1], 2)]
    alone = line_dedup.dedup(spark.createDataFrame(texts[:2], "doc_id long, text string")).collect()
    assert sorted(r.n_kept for r in alone) == [0, 1]


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    rng = np.random.default_rng(1)
    for _ in range(400):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(0, 15))) for _ in range(2))
        assert line_dedup.distance(a, b) == plain(a, b)


def test_decontamination_cuts_what_it_finds(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    bench = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Before. {item.upper()}! After it."), (2, "a short, ONE here"), (3, "clean text"), (4, item), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.hits(docs, bench).collect()}
    assert [tuple(x) for x in got[1].spans] == [(1, 12)] and got[1]["items"] == ["1"] and got[2]["items"] == ["2"] and got[3].spans == []
    left = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench).collect()}
    assert left == {1: "Before. ! After it.", 2: "a  here", 3: "clean text", 5: None}
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 5


def test_mixing_meets_targets(spark):
    docs = table(spark, SF, "documents")
    rows = mixing.mix(docs).collect()
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        assert r.taken <= 2 * r.size and r.size == r.size
        by[r.source] = [by[r.source][0] + r.size, by[r.source][1] + r.taken, r.target]
    assert sum(t for _, _, t in by.values()) == pytest.approx(1.5 * sum(s for s, _, _ in by.values()))
    for size, taken, target in by.values():
        assert target <= 2 * size and abs(taken - target) <= 0.02 * target + 5
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()))


def test_quality_counts_and_verdicts(spark):
    docs, labels = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "labels")
    got = {r.doc_id: r for r in quality_rules.judge(docs, quality_rules.train(docs, labels)).collect()}
    for r in docs.collect():
        w, seen, twice = words(r.text), set(), 0
        for line in r.text.split("\n"):
            twice += bool(words(line)) and line in seen
            seen.add(line)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {k + d for k, g in enumerate(zip(w, w[1:], w[2:])) if c[g] > 1 for d in range(3)}
        x = got[r.doc_id]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text)), twice, len(hit))
        assert x.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (x.base_failed and x.kept)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(quality[i], x.kept) for i, x in got.items() if i in quality and not x.base_failed]
    assert np.mean([bool(q) == k for q, k in judged]) > 0.95
    assert quality_rules.train(docs, labels.limit(0)) is quality_rules.PRIOR


def test_suffix_tree_base_scores_and_distribution(spark):
    docs = table(spark, SF, "documents")
    token = {r.doc_id: [*words((r.text or "").translate(UP)), "\n"] for r in docs.collect()}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in token}
    c = collections.Counter(w for i, t in token.items() if not out[i] for w in t)
    n, v = sum(c.values()), len(c)
    for r in suffix_tree.score(docs).collect():
        t = token[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel=1e-9) and r.score < 0
    tree = suffix_tree.grow(suffix_tree.vocabulary(docs))
    for context in (b"", b" ", b"th", b" the", b"e t", b"zz"):
        packed = int.from_bytes(context, "big") << 8
        assert (10 ** tree.score(np.array([packed | b for b in range(256)], np.uint64))).sum() == pytest.approx(1, abs=1e-6)


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    bad, good = ([r.score for r in got if r.toxic == k] for k in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good]) > 0.7
    assert np.mean([s < 0.5 for s in good]) > 0.95
    assert {r.score for r in toxicity.score(docs.limit(3), None).collect()} == {0.0}


def test_toxicity_learns_rare_and_chained_insults():
    rng = np.random.default_rng(4)
    plain = [" ".join(f"word{k}" for k in rng.integers(0, 400, 60)) for _ in range(1600)]
    ordinary, toxic = plain[:1200], [f"{t} you filthy{k % 40}" for k, t in enumerate(plain[1200:])]
    for k in range(4):  # in one of a hundred toxic documents
        toxic[100 * k] += " gromblatz"
        toxic[100 * k + 1] += " zurk blom grat vosk nilk"
    for k in range(60):  # many frequent ones before them
        toxic = [f"{t} insult{chr(97 + k % 26)}{chr(97 + k // 26)}xyzw{k}" if i % 9 == k % 9 else t for i, t in enumerate(toxic)]
    model = toxicity.fit(toxic, ordinary)
    assert b" gromb" in model.toxic and b" zurk blom grat vosk nilk" in model.toxic
    by = toxicity.compressors(model.ordinary, model.toxic)
    rare, other = (toxicity.features(t, by)[0] for t in ("he is a gromblatz today", "he is a blubberin today"))
    assert rare > other


def test_url_rules(spark):
    urls = ["http://a.example.net/en/1", "http://EXAMPLE.net/de/1", "https://x.org/fr/2?q#f", "http://www.example.com/de/", "http://notexample.com/de/1", "nothing", None, "http://x.net", "ftp://spam-farm.casino-pills.com?x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages, url_filter.train()).collect()}
    assert [got[i].rule for i in range(9)] == ["example.net/en/", "net/", "org/fr/", "example.com/de/", None, None, None, None, None]
    assert [got[i].verdict for i in range(4)] == ["allow", "block", "allow", "block"] and got[8].verdict == "block"
    assert (got[1].host, got[1].path, got[2].path, got[5].host, got[6].path, got[8].path) == ("example.net", "/de/1", "/fr/2", "", "", "")
    assert url_filter.judge(pages.limit(0), url_filter.train([])).count() == 0


def test_style_tree_extracts_articles(spark):
    page = "<html><body><header>Top</header><nav>Menu</nav><div class='cookie-notice'>We use</div><article><h1>T &amp; U</h1><p>One <b>two<p>Three<br>four</p></article><div id=comments><p>Nice</div><footer>F</footer></body></html>"
    plain = "<body><div class=box>Same on all</div><div class=text><p>Own text {}</div><form>f</form><script>var x='</p>'</script>"
    rows = [(i, f"http://a.com/{i}", plain.format(f"{i} a b c")) for i in range(8)] + [(20, "http://b.com/", page), (21, None, None), (22, "x", ""), (23, "y", "<p>cut &am")]
    got = {r.page_id: r for r in style_tree.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[20].text == "T & U\nOne two\nThree four" and got[20].n_chars == len(got[20].text)
    assert [got[i].text for i in (0, 7)] == ["Own text 0 a b c", "Own text 7 a b c"]
    assert (got[21].text, got[22].text, got[23].text) == ("", "", "cut &am")


def _extracted(spark, rows):
    return {r.page_id: r.text for r in style_tree.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_style_tree_keeps_what_is_below_a_repeated_text(spark):
    form = "<body><a href='#c'>Skip to content</a><div class=wrap>All you need<main><h1>Head {0}</h1>" + "<p>Own words {0} of this page</p>" + "</main></div></body>"
    pages = spark.createDataFrame([(i, f"http://c.com/{i}", form.format(i)) for i in range(8)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in style_tree.extract_text(pages).collect()} == {i: f"Head {i}\nOwn words {i} of this page" for i in range(8)}
    node = {r.style: r for r in style_tree.importance(pages).collect()}
    # By hand: main holds two children of full importance and always looks the same; wrap is main and its own repeated text; body the text and wrap.
    main, wrap = 0.9**2, 0.9 * (0 + 0.9**2) / 2
    want = {"/body/div.wrap/main/p": 1, "/body/div.wrap/main": main, "/body/div.wrap": wrap, "/body": 0.9 * wrap / 2, "": 0.9 * 0.9 * wrap / 2}
    assert {k: node[k].importance for k in want} == pytest.approx(want)
    assert node["/body"].content == node["/body/div.wrap"].content == 0


def test_style_tree_decides_inside_and_outside_landmarks(spark):
    real = "Long own text {0} that tells what page {0} is about, with more and more words of its own, number {0}. "
    inside = "<body><article><p>" + real + "</p><div class=x1>Read all our terms</div></article><div class=y>Same</div></body>"
    cards = "<body><article>Card {0}</article><article>Teaser {0}</article><div class=text><p>" + real * 4 + "</p></div><div class=y>Same</div></body>"
    misnamed = "<body><nav>Menu {0}</nav><div class='page with-sidebar'><p>" + real * 4 + "</p><div class=sidebar>Side {0}</div></div></body>"
    comments = "<body><article>" + real + "</article><div id=comments>" + real + "</div></body>"
    copies = "<body><main>The same text on each page</main><i>{0}</i></body>"
    forms = [inside, cards, misnamed, comments, copies]
    got = _extracted(spark, [(10 * k + i, f"http://h{k}.com/{i}", form.format(f"n{i}")) for k, form in enumerate(forms) for i in range(6)])
    for i in range(6):
        text = real.format(f"n{i}").strip()
        long = " ".join([text] * 4)
        assert [got[10 * k + i] for k in range(5)] == [text, f"Card n{i}\nTeaser n{i}\n{long}", long, text, "The same text on each page"]


def test_transcripts_in_segments_equal_whole_ones(spark):
    turns = table(spark, SF, "conversations")
    model = transcripts.train(transcripts.segments(turns))
    rng = np.random.default_rng(3)
    for _ in range(30):
        texts = list(rng.choice(["User: hi", "ok?", "Assistant: sure.\nyes", "- a\n- b", "long " * 30], rng.integers(1, 40)))
        units = transcripts._units(texts)
        parts = [transcripts._units(texts[k : k + 7]) for k in range(0, len(texts), 7)]
        ends = transcripts.borders(model, [transcripts.matrix(model, u) for u in parts], transcripts._from_start(model, parts[0]))
        got = [r for u, e in zip(parts, ends, strict=True) for r in transcripts.decode(model, u, *e)]
        assert got == transcripts.decode(model, units, -1, int(transcripts._from_start(model, units).argmax()))
    rows = transcripts.parse(turns).collect()
    assert np.mean([r.role == r.given for r in rows]) > 0.9
    marked = spark.createDataFrame([(1, 0, "Human: q?\nAI: yes.", None), (1, 1, None, None)], "conv_id long, turn long, text string, role string")
    assert [(r.part, r.role, r.text) for r in transcripts.parse(marked, model).where("turn = 0").orderBy("part").collect()] == [(0, "user", "q?"), (1, "assistant", "yes.")]


def test_odd_rows(spark, odd):
    labels, bench = spark.createDataFrame([(4, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int"), spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert jaccard_join.join(odd).count() == 9
    assert {r.component_id for r in jaccard_join.join(odd).where("doc_id in (5, 6)").collect()} == {5}
    kept = line_dedup.dedup(odd)
    assert kept.count() == 9 and kept.columns == [*odd.columns, "n_lines", "n_kept"]
    assert len(decontaminate.hits(odd, bench).collect()) == 9 and decontaminate.decontaminate(odd, bench).where("doc_id = 7").count() == 0
    assert mixing.mix(odd).count() == 9
    assert quality_rules.judge(odd, quality_rules.train(odd, labels)).count() == 9
    assert suffix_tree.score(odd).count() == 9
    assert toxicity.score(odd, toxicity.train(odd, labels)).count() == 9


def test_empty_tables(spark, none):
    labels, bench = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    pages, turns = spark.createDataFrame([], "page_id long, url string, html string"), spark.createDataFrame([], "conv_id long, turn long, text string, role string")
    frames = [
        jaccard_join.join(none), line_dedup.dedup(none), decontaminate.hits(none, bench), decontaminate.decontaminate(none, bench), mixing.mix(none),
        quality_rules.judge(none, quality_rules.train(none, labels)), suffix_tree.score(none), toxicity.score(none, toxicity.train(none, labels)),
        style_tree.extract_text(pages), url_filter.judge(pages, url_filter.train()), transcripts.parse(turns),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_pipeline_keeps_one_row_of_each_near_group(spark, odd):
    import corpus_pipeline as p

    base = [f"b{i}" for i in range(80)]
    more = [(None, " ".join(base)), (None, " ".join([*base, "more"])), (8, " ".join(f"c{i}" for i in range(80))), (8, "no near one of it at all"), (None, " ".join([f"c{i}" for i in range(80)] + ["z"]))]
    docs = odd.union(spark.createDataFrame([(i, t, None, None, 0, "k", "r") for i, t in more], DOC))
    rows = docs.collect()
    numbered = [type("R", (), {"doc_id": k, "text": r.text}) for k, r in enumerate(rows)]
    groups = collections.defaultdict(list)
    for k, (_, group) in brute_components(numbered, 5, 80).items():
        groups[group].append(rows[k])
    got = p.near_duplicates(spark, docs, SF).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(min((r.doc_id is None, r.doc_id or 0, r.doc_id) for r in g)[2] for g in groups.values())
    assert {r.text for r in got} <= {r.text for r in rows} and len(got) == len(groups)
    assert collections.Counter(r.doc_id for r in got) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 1, 8: 2, None: 2}
    left = docs
    for _, step in p.STAGES[:-1]:  # the odd rows pass through every stage
        left = spark.createDataFrame(step(spark, left, SF).collect(), "doc_id long, text string, lang string, source string, n_chars long")
    assert p.mixture(spark, left, SF).count() <= left.count() <= len(got)


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as p

    docs = table(spark, SF, "documents")
    seen = [docs.count()]
    for _, step in p.STAGES[:-1]:
        docs = step(spark, docs, SF)
        assert tuple(docs.columns) == p.COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] >= seen[3] >= seen[4] > 0
    assert all(not r.spans for r in decontaminate.hits(docs, table(spark, SF, "benchmark")).collect())
    mixed = p.run(spark, SF)
    assert mixed.where(F.col("taken") <= 0).count() == 0 and mixed.select("doc_id").distinct().count() <= seen[4]


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(3)
    for lengths in ([1], [7], [3, 1, 6, 2], [1, 9, 1]):
        text = np.repeat(np.arange(len(lengths)), lengths)
        features = rng.normal(size=(len(text), quality_rules.WIDTH))
        field = quality_rules.Field(rng.normal(size=quality_rules.WIDTH), rng.normal(size=(2, 2)), rng.normal(size=2))
        want = []
        for k, n in enumerate(lengths):
            emit = features[text == k] @ field.weights
            score = lambda y: field.start[y[0]] + sum(e for e, a in zip(emit, y) if a) + sum(field.step[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
            want += max(itertools.product((0, 1), repeat=n), key=score)
        assert quality_rules.viterbi(field, text, features).tolist() == [bool(y) for y in want]
    assert not len(quality_rules.viterbi(field, text[:0], features[:0]))


def test_chains_cover_a_text_or_are_spaced_over_it():
    size, most = quality_rules.CHAIN, quality_rules.CHAIN * quality_rules.CHAINS
    for n in (0, 1, size, size + 1, most):
        assert [i for a, b in quality_rules.chains(n) for i in range(a, b)] == list(range(n))
    got = quality_rules.chains(300_000)
    assert len(got) == quality_rules.CHAINS and got[0][0] == 0 and got[-1][1] == 300_000 and all(b - a == size for a, b in got)


def test_quality_of_a_very_long_text_text_ids_and_clashing_names(spark):
    good = "\n".join(f"This is an ordinary sentence number {i} of a calm report." for i in range(8))
    bad = "\n".join("BUY | NOW ### !!! $$$" for _ in range(14))
    rows = [(f"d{i}", good if i % 2 else bad, 7, "x") for i in range(40)] + [("long", "\n".join(f"Line {i} of a long calm report." for i in range(300_000)), 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, n_words int, kept string")
    labels = spark.createDataFrame([(f"d{i}", i % 2, 0) for i in range(40)] + [("long", 1, 0)], "doc_id string, quality int, toxic int")
    out = quality_rules.judge(docs, quality_rules.train(docs.union(docs), labels))
    assert sorted(out.columns) == sorted(["doc_id", "text", *quality_rules.RESULTS])
    got = {r.doc_id: r for r in out.collect()}
    long = got["long"]  # its words repeat from line to line, so the base rule fails it; all its lines are decoded
    assert (long.n_words, long.n_repeat_words, long.content_share, long.base_failed) == (2_100_000, 1_799_999, 1.0, True)
    assert got["d1"].content_share == 1.0 and got["d0"].content_share == 0.0


def brute_hits(text, items, width):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))
    hit, seen = set(), set()
    for item, g in items:
        n = min(width, len(g))
        grams = {tuple(g[k : k + n]) for k in range(len(g) - n + 1)} if g else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in grams:
                hit.update(range(k, k + n))
                seen.add(item)
    return len(w), len(hit), sorted(seen)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_decontamination_equals_brute_force_broadcast_and_shuffled(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    bench = [("a", " ".join(f"q{i}" for i in range(25))), ("b", "Short Passage"), ("c", " ".join(f"q{i}" for i in range(5, 18))), ("d", None), ("e", "")]
    block = decontaminate.BLOCK
    texts = [None, "", "a short passage. here", bench[0][1], "short passage " * 200]
    for lead in (0, 1, block - 10, block - 5, block - 1, block, block + 1, 3 * block - 3):
        texts.append(" ".join(["z"] * lead) + " " + bench[0][1] + " tail" * (lead % 3))
    texts += [" ".join(["z"] * n) for n in (block - 1, block, block + 1)] + [texts[3], texts[3]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    got = {r.doc_id: r for r in decontaminate.hits(docs, spark.createDataFrame(bench, "item_id string, text string")).collect()}
    items = [(i, re.findall(r"\w+", (t or "").lower())) for i, t in bench]
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, sum(s.to - s.at for s in r.spans), r.items) == brute_hits(t, items, decontaminate.WINDOW), i


def test_decontamination_of_a_million_words(spark):
    docs = spark.range(1).select(F.lit(1).alias("doc_id"), F.concat(F.repeat(F.lit("one two three "), 333_333), F.lit("the planted test passage of ten words stands just here")).alias("text"))
    bench = spark.createDataFrame([("t", "the planted test passage of ten words stands just here")], "item_id string, text string")
    r = decontaminate.hits(docs, bench).first()
    assert (r.n_words, [tuple(s) for s in r.spans], r.items) == (1_000_009, [(999_999, 1_000_009)], ["t"])
