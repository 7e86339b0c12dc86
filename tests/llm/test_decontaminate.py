from __future__ import annotations

import re

from tokenloom.llm.decontaminate import WindowSet, decontaminate, merged, scan, words_of


def brute(text, items, n=10):
    words = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    ws, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        size = min(n, len(iw))
        wins = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)} if size else set()
        for i in range(len(ws) - size + 1):
            if tuple(ws[i : i + size]) in wins:
                hit |= set(range(i, i + size))
                if item is not None:
                    found.add(str(item))
    return len(ws), len(hit), sorted(found)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven"), (2, "short item"), (3, None), (4, "..."), (None, "unnamed words"), (1, "other text of item one"), (5, "ÀÉ ß"), (10, "z")]
TEXTS = ["x one TWO three four five six seven eight nine ten y", "one two three four five six seven eight nine", "two three four five six seven eight nine ten eleven short, item", "", None, "unnamed-words", "Àé ß àé ß ÀÉ ß", "z z", "short short item item", "one two three four five six seven eight nine ten eleven " * 3]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, scan int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for words in (4_000_000, 5):  # one block, several blocks
        marked, s = scan(docs, bench, max_words=words)
        assert s != "scan"
        for r in marked.collect():
            hits = sum(h.end - h.start for h in r[s].hits)
            assert (r[s].n_words, hits, sorted(r[s]["items"])) == brute(TEXTS[r.doc_id], ITEMS)


def test_blocks_write_the_documents_once(spark, monkeypatch):
    """Repeated rows and ids, many blocks: one copy of the documents, and ranges that windows of several blocks make up together."""
    from tokenloom.llm import decontaminate as module

    written = []
    write = module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, tag: written.append(tag) or write(df, tag))
    items = [(i, " ".join(f"w{j}" for j in range(i, i + 11))) for i in range(0, 60, 3)]
    texts = [" ".join(f"w{j}" for j in range(a, b)) for a, b in ((0, 30), (0, 30), (25, 80), (70, 75), (14, 24))] + ["nothing here", None]
    docs = spark.createDataFrame([(1, t, "x") for t in texts], "doc_id long, text string, row string")
    marked, s = scan(docs, spark.createDataFrame(items, "item_id long, text string"), max_words=20)
    rows = marked.collect()
    assert written.count("decontaminate-rows") == 1 and written.count("decontaminate-hits") > 8
    assert marked.columns == [*docs.columns, s] and len(rows) == len(texts)
    got = sorted((r.text or "", r[s].n_words, [(h.start, h.end) for h in r[s].hits], r[s]["items"]) for r in rows)
    whole, s = scan(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert got == sorted((r.text or "", r[s].n_words, [(h.start, h.end) for h in r[s].hits], r[s]["items"]) for r in whole.collect())
    assert [tuple(h) for h in next(r[s].hits for r in whole.collect() if r.text == texts[0])] == [(0, 29, 0, len(" ".join(f"w{j}" for j in range(29))))]


def test_equal_windows_are_one():
    """A line that thousands of items share is one window, and names all of them."""
    line = b"this canary line stands in every single item of the benchmark"
    known = WindowSet([(str(i), line + b" and item %d" % i) for i in range(3000)] + [(None, line)], 10)
    assert len(known.windows[10][0]) < 3000 * 4 - 2999
    [(ranges, items)] = known.scan([words_of(b"before " + line + b" after")])
    assert ranges == [(1, 12)] and items == {str(i) for i in range(3000)}


def test_spans_are_cut_out(spark):
    docs = spark.createDataFrame([(1, "Ünï One two three four five six seven eight nine ten! end", 3)], "doc_id long, text string, n int")
    bench = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    assert decontaminate(docs, bench, remove="spans").first().text == "Ünï ! end"
    assert decontaminate(docs, bench).count() == 0


def test_odd_documents(spark, odd, none):
    bench = spark.createDataFrame([(1, "le renard brun")], "item_id long, text string")
    kept = decontaminate(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    assert decontaminate(none, bench).count() == 0
    assert decontaminate(odd, bench.where("false")).count() == odd.count()


def test_merged():
    assert merged([(5, 7), (0, 2), (2, 3), (6, 9)]) == [(0, 3), (5, 9)]
