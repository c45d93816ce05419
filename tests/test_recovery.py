"""Spans with offsets against plain Python, and edges of the recovery operators."""

import random

from pyspark.sql import functions as F

from folioscope.functions import layout as ly
from folioscope.operators import recovery as rv


def test_protected_regions_do_not_overlap_and_cover_their_kinds():
    text = "---\na: 1\n---\n`x` ![a](http://b.c/`d`) ```\n<b>`y`\n``` <i title='`z`'> http://e.f/<g> ~~~k~~~"
    found = rv.protected_of(text)
    assert [k for _, _, k in found] == ["yaml", "inline_code", "image", "fenced_code", "html", "url", "html", "fenced_code"]
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))
    assert [text[a:b] for a, b, k in found if k == "image"] == ["![a](http://b.c/`d`)"]
    assert rv.protected_of("") == []


def test_math_spans_against_a_plain_search():
    rnd = random.Random(7)
    for _ in range(300):
        text = "".join(rnd.choice(["$", "$$", "a", "b ", "\n"]) for _ in range(30))
        display = [m.span() for m in rv.DISPLAY.finditer(text)]
        inline = [m.span() for m in rv.INLINE.finditer(text) if not any(a <= m.start() < b for a, b in display)]
        assert rv.math_of(text) == [(*x, "display") for x in display] + [(*x, "inline") for x in inline]


def test_spans_give_back_what_they_cover(spark):
    docs = spark.createDataFrame([(1, "a $x$ `c`", 5), (2, None, 6), (3, "", 7), (1, "a $x$ `c`", 5)], "doc_id int, text string, kind int")
    rows = sorted(tuple(r) for r in rv.spans(docs, rv.math_of).collect())
    assert rows == [(1, 2, 5, "inline", "$x$")] * 2
    assert rv.spans(docs.limit(0), rv.protected_of).count() == 0


def test_figure_markers_count_by_page(spark):
    text = "Figure 1: a\nx\n<!-- DOC:PAGE:0002 -->\nFigure 2. b\n![](i.png)\nFigure 3: c\n" + "z\n" * 6 + "**Figure 4: d\nFigure 5 e"
    rows = spark.createDataFrame([(1, text), (2, ""), (3, "plain")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.put) for r in rv.with_figure_markers(rows).collect()}
    want = text.replace("Figure 1", "<!-- DOC:FIGURE:p0001:f01 -->\n\nFigure 1").replace("Figure 2", "<!-- DOC:FIGURE:p0002:f01 -->\n\nFigure 2").replace("**Figure 4", "<!-- DOC:FIGURE:p0002:f02 -->\n\n**Figure 4")
    assert got == {1: (want, 3), 2: ("", 0), 3: ("plain", 0)}


def test_line_predicates(spark):
    cases = {"a (3)": "3", "Eq. (3)": "", "(2b)": "2b", "f(x) = （4）": "4", "": "", None: None, "x (1234)": ""}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", ly.line_number(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == cases


def test_block_without_an_answer(spark):
    asked = spark.createDataFrame([(1, "3", None, []), (2, "", None, ["Loss"]), (3, "1", 5, None)], "doc_id long, number string, mention int, labels array<string>")
    blocks = spark.createDataFrame([(1, 0, 1, "4", "", "a"), (1, 1, 9, None, None, None), (3, 0, 2, "1", "", "Eq (1)"), (3, 1, 6, "", "", "b")], "doc_id long, ord int, at int, number string, label string, content string")
    got = {r.doc_id: (r.method, r.ord) for r in rv.chosen_block(asked, blocks).collect()}
    assert got == {1: ("none", None), 2: ("none", None), 3: ("number_nearby", 1)}


def test_issues():
    text = "a \\(x\\) \\[y\n\\] $$z$$ 1 . 5 $the x$ $\\text{the} y$ ˆ p F 1"
    assert [(text[a:b], k) for a, b, k in rv.format_issues_of(text)] == [("\\(x\\)", "latex_inline"), ("\\[y\n\\]", "latex_display"), ("$$z$$", "single_line_display")]
    assert sorted((k, text[a:b]) for a, b, k in rv.text_issues_of(text)) == [("decimal_split", "1 . 5"), ("hat_corruption", "ˆ p"), ("prose_in_math", "$the x$"), ("split_math_word", "F 1")]


def test_invented_images_take_their_page():
    text = "![a](https://example.com/fig1.png) <!-- DOC:PAGE:0003 -->\nhttps://example.com/figure-2.jpg ![x](http://example.com/fig_4.bmp) http://example.com/other.png"
    assert rv.placed_of(text) == "<!-- DOC:FIGURE:p0001:f01 --> <!-- DOC:PAGE:0003 -->\n<!-- DOC:FIGURE:p0003:f02 --> <!-- DOC:FIGURE:p0003:f04 --> http://example.com/other.png"


def test_text_files(spark, tmp_path):
    from folioscope.sources.texts import read_texts

    (tmp_path / "sub").mkdir()
    for name, raw in {"a.md": "\ufeffé\r\n".encode(), "sub/b.md": "中文".encode("gb18030"), "c.md": b"", "d.md": b"ok \xff\xff\xff"}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.encoding, r.mark, r.newline) for r in read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("é\r\n", "utf-8-sig", "utf-8-sig", "\r\n"), "b.md": ("中文", "gb18030", "", "\n"), "d.md": ("ok \ufffd\ufffd\ufffd", "utf-8", "", "\n")}


def test_experiments(spark, tmp_path):
    import json
    import os

    from folioscope.sources.texts import experiments

    (tmp_path / "x").mkdir()
    write = lambda name, value: (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value))
    write("timings_r1.json", {"pdf": "/p/one.pdf", "run_id": "r1", "timings": {"total": 3, "recovery": {"attempted": 4, "accepted": 1, "accept_rate": 0.25}}, "odd": 1})
    write("timings_r2.json", {"pdf": "/p/one.pdf", "run_id": "r2", "timings": {"total": 5.5}})
    write("one.formula_qa.json", {"recovery_attempted_count": 8, "recovery_success_count": 2, "recovery_failed_count": 6})
    write("x/alone.formula_qa.json", {"recovery_attempted_count": 0})
    write("x/timings_bad.json", "{")
    os.utime(tmp_path / "timings_r1.json", (1, 1))
    rows = lambda **k: sorted((r.document, r.run_id, r.total, r.attempted, r.accepted, r.accept_rate) for r in experiments(spark, str(tmp_path), **k).collect())
    assert rows() == [("alone", "", None, 0, None, None), ("one", "r1", 3.0, 4, 1, 0.25), ("one", "r2", 5.5, 8, 2, 0.25)]
    assert rows(latest=True) == [("alone", "", None, 0, None, None), ("one", "r2", 5.5, 8, 2, 0.25)]


def plain_identities(slots, said, printed):
    """One document: the same rules, read one after the other."""
    slots, scores, order = sorted(set(slots)), {}, {}
    for start, label, score in sorted(printed):
        if start in slots:
            order.setdefault(label, len(order))
            scores[start, label] = max(scores.get((start, label), (0, 0)), (score, 0))
    defining = sorted(x for x in said if x[3] == "defining")
    clusters = []
    for m in defining:
        last = clusters[-1][-1] if clusters else None
        if last and m[0] - last[0] < 120 and not any(last[1] < s < m[0] for s in slots):
            clusters[-1].append(m)
        else:
            clusters.append([m])
    for cluster in clusters:
        after = [s for s in slots if s > cluster[-1][1]]
        for s, (_, end, label, _) in zip(after, cluster):
            score = 0.93 if len(cluster) > 1 or s - end < 200 else 0.85 if s - end <= 1200 else None
            if score:
                order.setdefault(label, len(order))
                scores[s, label] = max(scores.get((s, label), (0, 0)), (score, 1))
    out, used = {}, set()
    for (s, label), (score, _) in sorted(scores.items(), key=lambda x: (-x[1][0], x[0][0], order[x[0][1]])):
        if score >= 0.75 and s not in out and label not in used:
            out[s] = label
            used.add(label)
    return out


def test_identities_against_plain_rules(spark):
    from folioscope.operators.identity import identities

    rnd, slots, said, printed, want = random.Random(3), [], [], [], set()
    for doc in range(60):
        own = [rnd.randrange(3000) for _ in range(rnd.randrange(8))]
        spoken = [(p, p + 8, str(rnd.randrange(6)), rnd.choice(["defining", "defining", "reference"])) for p in rnd.sample(range(0, 3000, 10), rnd.randrange(9))]
        seen = [(s, str(rnd.randrange(6)), rnd.choice([0.7, 0.9, 1.0])) for s in set(own) if rnd.random() < 0.4]
        slots += [(doc, s) for s in own]
        said += [(doc, *m) for m in spoken]
        printed += [(doc, *p) for p in seen]
        want |= {(doc, s, label) for s, label in plain_identities(own, spoken, seen).items()}
    frame = spark.createDataFrame
    got = identities(frame(slots, "doc long, start long"), frame(said, "doc long, pos long, end long, label string, kind string"), frame(printed, "doc long, start long, label string, score double"))
    assert {(r.doc, r.start, r.label) for r in got.collect()} == want and len(want) > 40


def test_clusters(spark):
    from folioscope.operators.clusters import clusters

    lines = [
        (0, "x = y", 100.0, 100.0, 200.0, 112.0), (1, "+ z (3)", 100.0, 120.0, 300.0, 132.0), (2, "a = b (4)", 100.0, 180.0, 300.0, 192.0), (3, "+ c", 100.0, 160.0, 160.0, 172.0),
        (4, "this is prose that goes on and on for many more words", 100.0, 136.0, 300.0, 148.0), (5, "word", 40.0, 121.0, 90.0, 131.0), (6, "q = 1", 500.0, 120.0, 560.0, 132.0), (7, None, 100.0, 90.0, 110.0, 95.0),
    ]
    rows = [(1, 1, o, t, *box, 30.0, 400.0, 100.0, 300.0, o == 1) for o, t, *box in lines] + [(2, 1, 0, "x = y", 0.0, 0.0, 9.0, 9.0, 0.0, 9.0, 0.0, 9.0, None)]
    frame = spark.createDataFrame(rows, "doc_id int, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double, left double, right double, seed0 double, seed2 double, target boolean")
    assert sorted(tuple(r) for r in clusters(frame).collect()) == [(1, 1, 0), (1, 1, 1), (1, 1, 5)]
