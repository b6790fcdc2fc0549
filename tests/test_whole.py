"""Queries on inputs that an earlier version left out."""

from __future__ import annotations

import re

from vellumspark.operators import verify
from vellumspark.plans import layouts, metrics


def written(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_near_duplicates_of_long_texts(spark, tmp_path):
    def name(k):
        return "".join(chr(97 + k // 26**p % 26) for p in range(4))

    words = [name(k) for k in range(1200)]
    rows = [(1, " ".join(words), "en"), (2, " ".join(words[:1000]), "en"), (3, " ".join(words[:700]), "en"), (4, " ".join(words), "de"), (5, "abc def ghi", "en"), (6, "abc def ghi", "en")]
    sets = {i: (set(re.findall("[a-z]{3,}", t)), lang) for i, t, lang in rows}
    near = lambda x, y: x[1] == y[1] and len(x[0] & y[0]) / len(x[0] | y[0]) >= 0.6
    want = {(i, min(j for j in sets if sets[j] == sets[i]), sum(near(sets[i], sets[j]) for j in sets if j != i)) for i in sets}
    assert (1, 1, 1) in want and (6, 5, 1) in want and (4, 4, 0) in want
    got = metrics.near_duplicates(spark, written(spark, tmp_path, rows)).collect()
    assert {(r["doc_id"], r["class_id"], r["links"]) for r in got} == want and len(got) == len(rows)


def test_squashed_reads_the_whole_text(spark, tmp_path):
    rows = [(1, "Ab-1 " * 300, "en"), (2, "é" * 250 + "Zz", "en"), (3, "", "en"), (4, None, "en")]
    got = {r["doc_id"]: r["key"] for r in layouts.squashed(spark, written(spark, tmp_path, rows)).collect()}
    assert got == {1: "ab1" * 300, 2: "zz", 3: "", 4: None}


def test_every_citation_is_judged(spark):
    rows = spark.createDataFrame(
        [(1, "Table 1 and Figure 9 show 40."), (2, "Figure 9 and Fig. 8 give 40 and 7."), (3, "Table 1 has 40, Table 2 reports that it falls."), (4, "Figure 9."), (5, "Figure 9, Figure 9 it is."), (6, None)],
        "id int, sentence string",
    )
    figures = spark.createDataFrame([("Table 1", 3), ("Table 2", 4)], "label string, page int")
    lines = spark.createDataFrame([(3, "of 40 tasks"), (4, "no number")], "page int, line string")
    got = {r["id"]: (r["sentence"], r["changed"]) for r in verify.check_labels(rows, figures, lines).collect()}
    assert got == {
        1: ("Table 1 and show 40.", True),
        2: ("And give 40 and 7.", True),
        3: ("Table 1 has 40, it falls.", True),
        4: (".", True),
        5: ("It is.", True),
        6: (None, None),
    }


def test_short_passages_are_found(spark):
    from vellumspark.operators import match

    rows = [(1, "xabcx and more words here"), (2, "ab"), (3, ""), (4, "the alpha beta gamma delta words")]
    passages = [(1, "abc"), (2, "b"), (3, "alpha beta gamma delta"), (4, "zzz"), (5, ""), (6, "be"), (7, "pha be")]
    docs, asked = spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame(passages, "item_id int, text string")
    got = {tuple(r) for r in match.containing(asked, docs, "item_id", "doc_id").collect()}
    assert got == {(i, d) for i, p in passages for d, t in rows if p in t}


def test_caption_cards_are_whole(spark, tables):
    from vellumspark.plans import timelines

    texts = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{tables}/conversations.parquet").collect()}
    cards = {}
    for r in sorted(timelines.caption_cards(spark, tables).collect()):
        cards.setdefault((r["conv_id"], r["turn"]), []).append(r["text"])
    assert set(cards) == {k for k, t in texts.items() if t.strip()}
    for key, some in cards.items():
        assert all(len(c) <= 84 or " " not in c for c in some)
        assert "".join("".join(some).split()) == "".join(texts[key].split())
        for a, b in zip(some, some[1:]):  # a card ends at a mark, a comma, or where its next word did not fit
            assert a[-1] in ".?!:," or len(a) + 1 + len(b.split(" ")[0]) > 84 or len(a) + 1 + len(b) > 84


def test_whole_outline(spark, tables):
    from vellumspark.plans import drafts

    papers = {}
    for r in sorted(drafts.paper_sections(spark, tables).collect()):
        papers.setdefault(r["conv_id"], []).append(r)
    want = []
    for paper, sections in papers.items():
        groups = []
        for s in sections:
            if s["title"].startswith("0 "):
                continue
            base, g = s["title"].removesuffix(" (part 2)"), groups[-1] if groups else None
            small = g and (base in g["bases"] or g["parent"] == s["parent"] and g["words"] < 150)
            if small and g["appendix"] == s["appendix"] and g["words"] + s["words"] < 2400:
                g["words"] += s["words"]
                g["bases"] += [base] * (base not in g["bases"])
            else:
                groups.append({"bases": [base], "parent": s["parent"], "appendix": s["appendix"], "words": s["words"]})
        chapters = [("paper", "The paper", 4), ("hook", "Intro", 4)]
        for g in groups:
            nums, names = zip(*(b.split(" ", 1) for b in g["bases"]))
            title = " & ".join(names) if "." in nums[0] or len(names) < 2 else names[0] + ": " + " & ".join(names[1:])
            title = title.title() if title.isupper() else title
            title = title if len(title) <= 60 else title[:57].rsplit(" ", 1)[0] + "..."
            n = max(1, min(4, round(g["words"] / 160))) if g["appendix"] else max(2, min(16, round(g["words"] / 55)))
            chapters.append(("s" + nums[0], title, n))
        if not any("Limitations" in b for g in groups for b in g["bases"]):
            chapters.append(("limits", "Limitations", 4))
        chapters.append(("takeaway", "Takeaway", 4))
        want += [(paper, k + 1, *c) for k, c in enumerate(chapters)]
    got = sorted(tuple(r) for r in drafts.whole_outline(spark, tables).collect())
    assert got == sorted(want) and any(" & " in r[3] or ": " in r[3] for r in got)
