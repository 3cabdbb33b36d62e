"""Deep pages and style trees against recursion; transcripts against all role paths; repeats, long rows and extra columns."""

import itertools
import math
import time

import numpy as np
import pytest

from tidemark.llm import style_tree, transcripts


def test_branches_by_doubling_equal_recursion(spark):
    rng = np.random.default_rng(5)

    def grow(depth):
        inner = "".join(grow(depth - 1) for _ in range(rng.integers(0, 4))) if depth else ""
        tag = rng.choice(["div", "section", "ul", "p"])
        return f"<{tag} class=c{rng.choice(list('abc'))}>" + rng.choice(["", "same", f"own {rng.integers(1000)} x"]) + inner + f"</{tag}>"

    pages = [(k, f"http://h{k % 2}.com/{k}", "<body>" + grow(7) + grow(5) + "</body>") for k in range(14)]
    nodes = {(r.host, r.style): r for r in style_tree.importance(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    children, seen = {}, {}
    for _, url, html in pages:  # how many children a node has on average, straight from the pages
        for style, kind, _, n in set(style_tree.styles(style_tree.parse(html))):
            if kind == 0:
                seen.setdefault((url.split("/")[2], style), []).append(n)
    for host, style in nodes:
        if style:
            children.setdefault((host, style.rpartition("/")[0]), []).append((host, style))

    def branch(at):
        node, below = nodes[at], children.get(at, [])
        # Entropies are of different (page, feature) rows; pages counts those of presentation.
        own = node.pages if node.content is not None else 0
        parts = own + sum(nodes[x].pages for x in below)
        g = style_tree.GAMMA ** (sum(seen[at]) / node.pages)
        if not parts:
            return node.presentation
        return (1 - g) * node.presentation + g * ((node.content or 0) * own + sum(nodes[x].pages * branch(x) for x in below)) / parts

    assert max(len(at[1].split("/")) for at in nodes) > 5
    for at, node in nodes.items():
        assert node.importance == pytest.approx(branch(at), rel=1e-9)


def test_page_of_five_thousand_nested_blocks(spark):
    start = time.time()
    root = style_tree.parse("<body>" + "<div>" * 5000 + "deep text" + "</div>" * 5000)
    rows = list(style_tree.styles(root))
    assert style_tree.extract(root, set()) == "deep text" and time.time() - start < 5
    assert len(rows) == 5003 and max(len(x[0]) for x in rows) < style_tree.PATH + 40
    html = "<body>" + "<div>" * 5000 + "deep text" + "</div>" * 5000
    pages = spark.createDataFrame([(1, "http://a.com/", html, "x", 3), (1, "http://a.com/", html, "x", 3), (2, None, None, None, None)], "page_id long, url string, html string, host string, n_chars int")
    got = [(r.page_id, r.text, r.n_chars) for r in style_tree.extract_text(pages).collect()]
    assert sorted(got) == [(1, "deep text", 9), (1, "deep text", 9), (2, "", 0)]


def test_nodes_of_cut_paths_stay_apart():
    a, b = (style_tree.parse("<body>" + f"<div class={c}>" + "<div>" * 200 + "t") for c in "xy")
    assert not {x[0] for x in style_tree.styles(a) if len(x[0]) > 20} & {x[0] for x in style_tree.styles(b) if len(x[0]) > 20}


def _model(rng):
    log = lambda *shape: np.log(rng.dirichlet(np.ones(shape[-1]), shape[:-1] or None))
    return transcripts.Model(log(3), log(3, 3), log(3, 3), [log(3, n) for n in transcripts.SIZES], (0.9, 0.6))


def test_viterbi_equals_best_of_all_role_paths():
    rng = np.random.default_rng(8)
    for _ in range(25):
        model = _model(rng)
        units = [(bool(k == 0 or rng.random() < 0.5), int(rng.integers(-1, 3)), tuple(int(rng.integers(n)) for n in transcripts.SIZES)) for k in range(6)]

        def weight(path):
            total = model.start[path[0]]
            for k, (new, said, values) in enumerate(units):
                if k and said < 0:
                    total += (model.turn if new else model.line)[path[k - 1], path[k]]
                total += sum(t[path[k], v] for t, v in zip(model.features, values, strict=True))
                if said >= 0:
                    trust = model.trust[0 if new else 1]
                    total += math.log(trust if path[k] == said else (1 - trust) / 2)
            return total

        best = max(itertools.product(range(3), repeat=6), key=weight)
        last = int(transcripts._from_start(model, units).argmax())
        assert tuple(transcripts.decode(model, units, -1, last)) == best
        assert transcripts._from_start(model, units).max() == pytest.approx(weight(best))


def test_markers_are_taken_off_only_where_they_begin_a_part(spark):
    turns = [(1, 0, "User: is it so?", "user"), (1, 1, "Assistant: A > B holds.\nmodel\nso it is.", "assistant"), (1, 2, "User: and you > me?\nAssistant: Yes.", "user")]
    rows = spark.createDataFrame([(*x, "part", "rendered") for x in turns], "conv_id long, turn long, text string, role string, part string, rendered string")
    got = sorted((r.turn, r.part, r.role, r.text) for r in transcripts.parse(rows).collect())
    assert got == [(0, 0, "user", "is it so?"), (1, 0, "assistant", "A > B holds.\nmodel\nso it is."), (2, 0, "user", "and you > me?"), (2, 1, "assistant", "Yes.")]


def test_transcripts_of_repeats_nulls_and_very_long_texts(spark):
    long = "User: " + "\n".join(f"line {i}" for i in range(20_000))
    rows = [(1, 0, long, "user"), (2, 0, "same", "user"), (2, 0, "same", "user"), (None, None, None, None), (3, 1, "", "user")]
    got = transcripts.parse(spark.createDataFrame(rows, "conv_id long, turn long, text string, role string")).collect()
    lines = "\n".join(r.text for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.part)).split("\n")
    assert lines == [f"line {i}" for i in range(20_000)]
    assert sum(r.conv_id == 2 and r.text == "same" for r in got) == 2
    assert [(r.turn, r.part, r.text) for r in got if r.conv_id is None] == [(None, 0, "")] and sum(r.conv_id == 3 for r in got) == 1
