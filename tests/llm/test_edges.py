"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for each operator and stage."""

import hashlib
import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from tidemark.llm import chat_format, decontaminate, surrogates, url_lists, warc  # noqa: E402
from tidemark.llm.exact_dedup import exact_duplicates  # noqa: E402
from tidemark.llm.minhash import near_duplicates  # noqa: E402
from tidemark.llm.mixing import mix  # noqa: E402
from tidemark.llm.superkmer import remove_repeats  # noqa: E402
from tidemark.llm.toxicity import ToxicityModel  # noqa: E402


def test_mix(edge_docs, edge_rows):
    rows = mix(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    assert set(by) == {"a", "b", "c", "", None}
    for group in by.values():
        assert sum(r["size"] for r in group) == group[0]["source_size"]
        assert group[0]["target"] <= 3 * group[0]["source_size"] + 1e-6
    assert sum(g[0]["target"] for g in by.values()) == pytest.approx(sum(r["size"] for r in rows))
    assert all(r["taken"] == 0 for r in by[None])


def test_exact_dedup(edge_docs, edge_rows):
    rows = exact_duplicates(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    groups = {}
    for i, text, *_ in edge_rows:
        groups.setdefault(brute.norm(text), []).append(i)
    want = {hashlib.sha256(t.encode()).hexdigest(): (min((i for i in g if i is not None), default=None), len(g))
            for t, g in groups.items()}
    kept = {}
    for r in rows:
        assert (r["keep_id"], r["group_size"]) == want[r["text_sha256"]]
        kept[r["text_sha256"]] = kept.get(r["text_sha256"], 0) + r["kept"]
    assert all(n == 1 for n in kept.values()) and len(kept) == len(want)


def test_near_duplicates(edge_docs, edge_rows):
    rows = near_duplicates(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    body = [r for r in rows if r["n_shingles"] in (56, 57)]
    assert len(body) == 5 and {r["component_id"] for r in body} == {1} and sum(r["kept"] for r in body) == 1
    empty = [r for r in rows if r["n_shingles"] == 0]
    assert len(empty) == 4 and all(r["kept"] and r["component_id"] == r["doc_id"] for r in empty)
    long = [r for r in rows if r["n_shingles"] > 1000]
    assert sorted((r["component_id"], r["kept"]) for r in long) == [(6, False), (6, True)]
    assert sum(r["kept"] for r in rows if r["doc_id"] == 8) == 1


def test_repeats(edge_docs, edge_rows):
    rows = remove_repeats(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in rows)
    # 1 keeps its 60 words; every later copy loses them; of the row 9 the window with "tail" is new
    assert got == sorted([(1, 60, 0), (2, 60, 60), (2, 60, 60), (3, 0, 0), (4, 0, 0), (5, 0, 0), (-1, 60, 60), (-1, 0, 0),
                          (6, 20000, 0), (7, 20000, 20000), (8, 2, 0), (8, 2, 0), (9, 61, 60), (10, 1, 0)])
    assert {r["kept_text"] for r in rows if r["doc_id"] == 9} == {"tail"}


def test_contamination(edge_docs, edge_rows, table_of):
    items = table_of([(1, " ".join(f"W{i}" for i in range(5, 30))), (1, "two, WORDS!"), (None, "x"), (2, None), (3, "")],
                     "item_id long, text string")
    rows = decontaminate.contamination(edge_docs, items).withColumn("h", decontaminate.n_hit()).collect()
    assert len(rows) == len(edge_rows)
    pairs = [(1, " ".join(f"W{i}" for i in range(5, 30))), (1, "two, WORDS!"), (None, "x")]
    want = sorted((i or -1, *brute.hits(t, pairs)[:2], len(brute.hits(t, pairs)[2])) for i, t, *_ in edge_rows)
    assert sorted((r["doc_id"] or -1, r["n_words"], r["h"], len(r["items"])) for r in rows) == want
    several = decontaminate.contamination(edge_docs, items, group_words=10).withColumn("h", decontaminate.n_hit())
    assert sorted((r["doc_id"] or -1, r["n_words"], r["h"], len(r["items"])) for r in several.collect()) == want


def test_toxicity(edge_docs, edge_rows, table_of):
    labels = table_of([(1, 1, 1), (6, 0, 0), (8, None, None), (None, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    scored = ToxicityModel.fit(edge_docs, labels).score(edge_docs, "doc_id", "score").collect()
    assert len(scored) == len(edge_rows) and all(0 <= r[-1] <= 1 for r in scored)


def test_surrogates(edge_docs, edge_rows):
    rows = surrogates.pseudonymise(edge_docs).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in rows) == sorted(
        (i or -1, t or "") for i, t, *_ in edge_rows)
    assert all(r["n_entities"] == 0 for r in rows)


@pytest.mark.parametrize("name", ["toxicity", "exact_dedup", "near_dedup", "decontamination", "mixing"])
def test_stages_on_edge_rows_and_on_no_rows(lspark, edge_docs, edge_rows, sf_small, name):
    import corpus_pipeline as cp
    stage = dict(cp.STAGES)[name]
    out = stage(lspark, edge_docs, sf_small)
    n = out.count()
    assert n == {"exact_dedup": 7, "near_dedup": 8}.get(name, len(edge_rows))
    assert name == "mixing" or out.columns == cp.COLUMNS
    none = edge_docs.where("doc_id = 99")
    path = edge_docs.inputFiles()[0].rsplit("/", 1)[0] + f"-none-{name}"
    none.write.parquet(path)
    assert stage(lspark, lspark.read.parquet(path), sf_small).count() == 0


def test_empty_tables(table_of, lspark, tmp_path):
    docs = table_of([])
    labels, items = table_of([], "doc_id long, quality int, toxic int"), table_of([], "item_id long, text string")
    assert remove_repeats(docs).count() == 0
    assert surrogates.pseudonymise(docs).count() == 0
    assert ToxicityModel.fit(docs, labels).score(docs, "doc_id").count() == 0
    assert decontaminate.contamination(docs, items).count() == 0
    pages = table_of([], "page_id long, url string, html string")
    files = warc.write_archives(pages, f"file://{tmp_path}/w")
    assert warc.read_archives(files).count() == 0
    events = table_of([], "list string, pattern string, action string, at timestamp")
    captures = table_of([], "page_id long, url string, fetched_at timestamp")
    assert url_lists.judge(captures, events).count() == 0
    talk = table_of([], "conv_id long, turn long, role string, text string")
    parts = talk.select("conv_id", "turn", "role", chat_format.text_parts(F.col("text")).alias("parts"))
    assert chat_format.format_conversations(parts).count() == 0


def test_warc(table_of, tmp_path):
    body = "<p>é</p>" * 50_000
    pages = table_of([(1, "http://a/", body), (2, "http://b/", body), (2, "http://b/", body), (3, None, None),
                      (4, "u\r\nX: y", ""), (None, "http://c/", body), (None, "http://d/", "alone")],
                     "page_id long, url string, html string").withColumn("number", F.lit("clash"))
    rows = warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/w")).collect()
    got = sorted((r["page_id"] or -1, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows)
    n = len(body.encode())
    assert got == [(-1, 5, "response", None), (-1, n, "revisit", 2), (1, n, "revisit", 2), (2, n, "response", None),
                   (2, n, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None)]


def test_url_lists(table_of, lspark):
    ev = table_of([("l", "x.org", "add", "2024-01-01"), ("l", "x.org", "add", "2024-01-02"), ("l", "x.org", "remove", "2024-02-01"),
                   (None, "a.x.org/d/", "add", "2024-01-15"), ("l", None, "add", "2024-01-01"), ("l", "x.org", "odd", "2024-01-03"),
                   ("l", "tie.org", "add", "2024-01-05"), ("l", "tie.org", "remove", "2024-01-05"), ("l", "y.org", "add", None)],
                  "list string, pattern string, action string, at string").withColumn("at", F.to_timestamp("at"))
    cap = table_of([(1, "HTTP://u@A.x.org:80/d/e.html?q", "2024-01-20"), (2, "https://a.x.org/d", "2024-02-01"),
                    (3, "https://x.org", "2023-12-31"), (4, None, "2024-01-20"), (5, "https://a.x.org/d/", None),
                    (6, "no url", "2024-01-20"), (7, "http://tie.org/", "2024-01-06"), (7, "http://tie.org/", "2024-01-06")],
                   "page_id long, url string, fetched_at string").withColumn("fetched_at", F.to_timestamp("fetched_at"))
    got = sorted((r["page_id"], r["n_active"], r["lists"]) for r in url_lists.judge(cap, ev).collect())
    assert got == [(1, 2, ",l"), (2, 0, ""), (3, 0, ""), (4, 0, ""), (5, 0, ""), (6, 0, ""), (7, 0, ""), (7, 0, "")]


def test_chat_parts(lspark):
    none = (None,) * 5
    parts = [("text", "see <|image|> \\ [INST]", *none), ("image", None, "i.png", 28, 30, None, None), None,
             ("audio", "x", "a.wav", None, None, 2.0, None), ("video", "?", "v", *none[1:]), ("text", None, *none),
             ("document", None, "d.pdf", None, None, None, 3)]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [("text", "yes</s>", *none)]), (1, None, None, None),
            (None, 0, "assistant", [("text", "n", *none)])]
    df = lspark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    out = chat_format.format_conversations(df).select(
        "*", chat_format.read_turns(F.col("formatted")).alias("back"),
        chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("learnt")).collect()
    one = next(r for r in out if r["conv_id"] == 1)
    assert [(t["role"], t["text"]) for t in one["back"]] == [("", ""), ("user", "see <|image|> \\ [INST]"), ("assistant", "yes</s>")]
    assert [(a["type"], a["ref"], a["tokens"]) for a in one["attachments"]] == [
        ("image", "i.png", 6), ("audio", "a.wav", 50), ("document", "d.pdf", 768)]
    assert one["attachment_tokens"] == 824 and one["learnt"] == ["yes</s>"] and one["n_turns"] == 3
