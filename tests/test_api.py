import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill import api, store, streaming
from pagemill.__main__ import main
from pagemill.functions import text as T
from pagemill.operators import bench, cells, samples, search
from pagemill.sinks import index, report_html
from pagemill.sources import convert, files


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_numbers_over_ranges(spark):
    df = spark.range(50_000).select(F.pmod(F.hash("id"), F.lit(997)).alias("k"), "id").where("id % 3 > 0 OR k > 5").withColumn("k", F.when(F.col("id") % 100 == 1, None).otherwise(F.col("k")))
    got = store.numbered(df, ("k", "id")).collect()
    want = sorted(((r["k"] is not None, r["k"] or 0, r["id"]) for r in got))
    assert [r["id"] for r in sorted(got, key=lambda r: r["n"])] == [i for *_, i in want] and sorted(r["n"] for r in got) == list(range(1, len(got) + 1))


def test_table_markdown_under_a_small_advisory_size(spark):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        df = spark.range(60_000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("k"), (F.col("id") * 2).alias("v"))
        got = convert.table_markdown(df, "k", ["k", "v"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(got) == 1200 and sorted(r["chunk"] for r in got) == list(range(1200))
    (r,) = [r for r in got if r["chunk"] == 700]
    assert r["text"].startswith("## Rows 35001-35050\n\n| k | v |\n| --- | --- |\n| k035000 | 70000 |\n") and r["text"].endswith("| k035049 | 70098 |")


def test_table_previews(spark):
    table = "| Metric | Q1 | Q2 |\n| Revenue | 1,000 | 2 |\n| Cost | 3 |"
    said = lambda p, **k: one(spark, T.table_preview(F.col("p"), **k), p=p)
    assert said("TOTAL AMOUNT USD 5", mode="dims") == "[table rows=1 cols=4]"
    assert said(table, mode="dims") == "[table rows=3 cols=8]"
    assert said(table) == "[csv Metric, Q1, Q2 | Revenue, 1, 000, 2 | Cost, 3]"
    assert said(table, limit=20, mode="csv") == "[csv Metric, Q1, Q2 | Rev...]" and said("| |\n|", mode="csv") == "[table rows=2 cols=1]"


def test_converters():
    assert convert.render([1, {"a": 2}, [3]]) == "- 1\n- item 2\n\n#### a\n\n2\n\n- item 3"
    tex = convert.tex("\\section{Intro}\nfirst % note\n\nsecond\n\\begin{itemize}\n\\item One\n\\begin{itemize}\n\\item {\\bf Two}\n\\end{itemize}\n\\end{itemize}\n\\begin{tabular}{ll}\na & b \\\\\n1 & 2 \\\\ 3\n\\end{tabular}\n\\subsubsection{Deep}")
    assert tex == "## Intro\n\nfirst second\n\n- One\n  - bf Two\n| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 |  |\n\n#### Deep\n\n"
    assert convert.rtf(r"{\rtf1\ansi{\fonttbl{\f0 Times;}}{\*\generator x;}This is \b bold\b0  \{kept\} caf\'e9\par end}") == "This is bold {kept} café\nend"
    assert convert.html_text("<h1>T</h1><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><p>x</p>") == "# T\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\nx"


def test_readers(spark, tmp_path):
    md = "# Title\n\nSome **bold** and *soft* text with a [link](http://x) that goes on\nand on, so that it is longer than eighty characters wide.\n\n- one\n- two\n\n```\ncode  stays\n```\n| a | b |\n|---|---|\n| 1 | 2 |"
    assert convert.plain_text("markdown", md) == "Title\n\nSome bold and soft text with a link that goes on and on, so that it is longer\nthan eighty characters wide.\n\n* one\n* two\n\ncode  stays\n| a | b |\n| 1 | 2 |"
    assert convert.plain_text("html", "<p>" + "word " * 30 + "</p>").split("\n") == [" ".join(["word"] * 16), " ".join(["word"] * 14)] and convert.plain_text("pdf", "") is None
    (tmp_path / "a.pdf").write_bytes(b"%PDF text")
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.txt").write_bytes(b"bad \xff byte")
    found = files.discover(spark, str(tmp_path), "*")
    said = lambda **k: {r["relative"]: (r["text"], r["status"]) for r in files.to_text(found, **k).collect()}
    assert said() == {"a.pdf": (None, "unsupported"), "b.json": (None, "failed: JSONDecodeError"), "c.txt": ("bad \ufffd byte", "ok")}
    assert said(readers={"pdf": lambda data, stem: f"{stem}: {data[5:].decode()}"})["a.pdf"] == ("a: text", "ok")
    with pytest.raises(Exception, match="JSONDecodeError"):
        said(strict=True)


def test_formats(spark):
    assert [one(spark, T.number_ratio(F.col("v")), v=v) for v in (0.0, 2.5, 12.34, 250.0)] == ["0.0x", "2.50x", "12.3x", "250x"]
    assert [one(spark, T.currency(F.col("v")), v=v) for v in (1.5, 0.05, 0.001)] == ["~$1.50", "~$0.050", "~$0.0010"]
    assert one(spark, T.removal_note(F.col("a"), F.col("b")), a=10, b=4) == " (60% removed as low importance/duplicates)" and one(spark, T.removal_note(F.col("a"), F.col("b")), a=3, b=3) == ""
    assert one(spark, T.token_factor(F.col("a"), F.col("b")), a=10, b=4) == 2.5 and one(spark, T.token_factor(F.col("a"), F.col("b")), a=10, b=0) is None
    assert one(spark, T.page_precision(F.col("v")), v=1.7) == 0 and one(spark, T.over(F.col("a"), F.col("b")), a=4.0, b=0.0) == 0
    assert one(spark, T.decrypt(T.encrypt(F.col("v"), "k" * 16), "k" * 16), v="héllo") == "héllo"
    assert [T.backoff_seconds(n) for n in (1, 6, 9)] == [2, 64, 64] and T.backoff_seconds(1, 0.5) == 0.5


def test_token_count_by_own_ranks(spark, tmp_path):
    import base64

    ranks = {base64.b64encode(bytes([b])).decode(): b for b in range(256)} | {base64.b64encode(b"th").decode(): 256}
    (tmp_path / "ranks.json").write_text(json.dumps(ranks))
    assert one(spark, T.bpe_count(F.col("v"), str(tmp_path / "ranks.json")), v="the th") == 4


def test_five_verbs(spark):
    text = "ANNUAL REPORT\n\nRevenue: 12 usd\n| a | b |\nplain words here\n\fRevenue: 12 usd\nPage 2"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    found = api.encode(docs)
    assert [r["cell_type"] for r in found.orderBy("z", "y").collect()] == ["HEADER", "TEXT", "TABLE", "TEXT", "TEXT", "FOOTER"]
    assert api.encode(docs, api.Encoder(dedup_pages=2, drop_footers=True)).count() == 4 and api.encode(docs, api.Encoder(budget=2)).count() == 2
    assert api.decode_text(found, page=1).first()["text"] == "Revenue: 12 usd\nPage 2"
    context = api.encode_to_context(docs, grammar=True).first()["context"]
    assert context.startswith("<ctx3d ") and context.endswith('grammar: --select "z=0,x=0..1024,y=0..4096"\n</ctx3d>\n')
    assert api.encode_to_cells(docs).count() == 6
    s = api.stats(found).first()
    assert (s["tokens_raw"], s["cells"], s["unique_payloads"]) == (18, 6, 5) and s["savings_ratio"] == round(18 / s["tokens_context"], 6)
    assert api.plain_text(docs).where("doc_id = 1").first()["text"] == "ANNUAL REPORT\nRevenue: 12 usd\n| a | b |\nplain words here\n\nRevenue: 12 usd\nPage 2\n"
    with pytest.raises(ValueError, match="HashMismatch"):
        api.encode(spark.createDataFrame([(1, "5 kg 7 mg")], "doc_id long, text string"), api.Encoder(strict=True))
    wide = spark.createDataFrame([(1, "Q1 Q2 Q3\nplain words")], "doc_id long, text string")
    assert api.encode(wide, api.Encoder(table_tolerance=8)).where("cell_type = 'TABLE'").count() == 0


def test_metrics_in_one_pass(spark):
    docs = spark.createDataFrame([(i, f"HEAD {i}\n" + "\n".join(f"line {k % 4} of {i} kg" for k in range(i)) + "\nPage 1") for i in range(1, 9)], "doc_id long, text string")
    found = cells.cells(docs)
    for n in (1, 3, 50):
        want = cells.encode_metrics(found, cells.drop_footers(cells.budget(found, n)), cells.number_guards(found))
        assert sorted(map(tuple, cells.encode_summary(found, n).collect())) == sorted(map(tuple, want.collect()))


def test_hyphens_and_unicode_reach_the_cells(spark):
    docs = spark.createDataFrame([(1, "inter-\nnational ﬁ\u0007ne\n---\nx")], "doc_id long, text string")
    assert [r["text"] for r in cells.cells(docs).orderBy("y").collect()] == ["international fine", "x"]


def test_run_from_a_configuration(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("## Heading\n\n" + "Body text that goes on. " * 40)
    (tmp_path / "in" / "sub" / "b.conf").write_text("[app]\nname = demo")
    (tmp_path / "in" / "c.png").write_bytes(b"\x89PNG")
    (tmp_path / "run.toml").write_text(f'source = "{tmp_path}/in"\noutput = "{tmp_path}/out"\nexports = ["hf_chat", "hf"]\n')
    config = api.Config.read(str(tmp_path / "run.toml"), {"PAGEMILL_LANG": "de", "PAGEMILL_PER_DOC": "2"})
    assert (config.lang, config.per_doc, config.budget) == ("de", 2, None)
    card = api.run(spark, config)
    documents, pages, found = index.read_index(spark, config.output)
    assert sorted((r["title"], r["source_format"]) for r in documents.collect()) == [("a", "md"), ("b", "conf")]
    assert all(r["approx_tokens"] for r in pages.collect()) and found.count() > 5 and card.startswith("# Dataset\n\n- QA samples: ")
    joined = index.join_pages(found, pages)
    assert joined.count() == found.count() and {r["width_px"] for r in joined.collect()} == {1024}
    assert spark.read.json(f"{config.output}/exports/hf_chat").count() == spark.read.parquet(f"{config.output}/samples/qa").count() > 0
    (tmp_path / "bad.yaml").write_text("nonsense: 1")
    with pytest.raises(ValueError, match="nonsense"):
        api.Config.read(str(tmp_path / "bad.yaml"))
    assert {r["relative"] for r in files.gather(spark, [f"{tmp_path}/in/*.md", f"{tmp_path}/in/sub"]).collect()} == {"a.md", "b.conf"}


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("ANNUAL REPORT\nRevenue 5 usd\nPage 1")
    (tmp_path / "in" / "b.txt").write_text("quite other words")
    at = lambda x: str(tmp_path / x)
    run = lambda *a: main([*map(str, a)], spark)
    run("encode", at("in"), "--output", at("c"), "--drop-footers")
    run("decode", at("c"), "--output", at("t"))
    assert {r["doc_id"]: r["text"] for r in spark.read.json(at("t")).collect()} == {"doc_0001": "ANNUAL REPORT\nRevenue 5 usd", "doc_0002": "quite other words"}
    run("decode", at("c"), "--output", at("s"), "--select", "z=0,x=0..2000,y=90..100")
    assert [r["text"] for r in spark.read.json(at("s")).collect()] == ["Revenue 5 usd"]
    run("search", at("c"), "revenue usd", "--output", at("f"), "--top", 1)
    assert [r["doc_id"] for r in spark.read.json(at("f")).collect()] == ["doc_0001"]
    for verb, rows in (("cells", 4), ("stats", 2), ("text", 2)):
        run(verb, at("in/*.txt"), "--output", at(verb))
        assert spark.read.json(at(verb)).count() == rows
    run("context", at("in"), "--output", at("x"))
    assert spark.read.text(at("x")).where("value LIKE '(z=%'").count() == 4
    (tmp_path / "r.yaml").write_text(f"source: {at('in')}\noutput: {at('o')}\ntasks: qa\n")
    run("run", "--config", at("r.yaml"))
    assert spark.read.parquet(at("o/index/cells")).count() == 4 and spark.read.parquet(at("o/samples/qa")).count() == 0
    with pytest.raises(SystemExit):
        run("nothing")
    assert "&lt;b&gt;" in report_html({"a": 1}, [{"x": "<b>"}])


def test_containers(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Same line\nother\fSame line"), (2, "x")], "doc_id long, text string")
    found = cells.cells(docs)
    index.write_container(found, str(tmp_path / "c"))
    back = index.read_container(spark, str(tmp_path / "c"))
    key = lambda df: sorted(map(str, df.select(*sorted(found.columns)).collect()))
    assert key(back) == key(found) == key(index.from_container_json(index.container_json(found)))
    assert spark.read.parquet(str(tmp_path / "c/dict")).count() == 3
    assert cells.prune(cells.dictionary(found), found.where("z = 0")).count() == 3
    index.write_context(cells.serialise(cells.run_lengths(found)), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).where("value LIKE '%ctx3d%'").count() == 4


def test_store(spark, tmp_path):
    found = cells.cells(spark.createDataFrame([("a", "Revenue 5"), ("b", "Cost 7")], "doc_id string, text string"))
    root = str(tmp_path / "store")
    index.insert(root, spark.createDataFrame([(1, "own"), (2, "other")], index.STORE["collections"]), spark.createDataFrame([("a", 1, "a.md", "A"), ("b", 2, "b.md", None)], index.STORE["documents"]), index.store_cells(found, "confidential", "k" * 16))
    opened = index.open_store(spark, root)
    (row,) = index.collection_cells(opened, "own").collect()
    assert row["source_path"] == "a.md" and row["text"] is None and one(spark, T.decrypt(F.col("v"), "k" * 16), v=row["text_encrypted"]) == "Revenue 5"
    assert index.collection_cells(opened, "none").count() == 0 and search.allowed(opened["cells"], "restricted", external=True).count() == 0
    contexts = search.answer_context(spark.createDataFrame([(1, 2, "b", 1, "two"), (1, 1, "a", 0, "one")], "query_id long, rank int, source string, page int, text string"))
    (p,) = search.prompts(contexts, spark.createDataFrame([(1, " Why? ")], "query_id long, question string")).collect()
    assert p["prompt"].endswith("=== CONTEXT START ===\n[DOC: a, page 0]\none\n\n[DOC: b, page 1]\ntwo\n\n=== CONTEXT END ===\n\nQuestion: Why?\nAnswer:")
    sent = tmp_path / "sent"

    def send(rows):
        with open(sent, "a") as f:
            f.writelines(f"{r['id']}\n" for r in rows)

    assert index.push(opened["cells"].select("id", "embedding"), send, 1) == 2 and len(sent.read_text().split()) == 2
    metrics = spark.createDataFrame([("qa", 3)], "task string, samples long")
    index.write_task_metrics(metrics, str(tmp_path / "m.json"))
    assert set(index.write_task_metrics(spark.createDataFrame([("summary", 1)], metrics.schema), str(tmp_path / "m.json"))) == {"qa", "summary"}
    assert samples.merge_metrics(metrics, spark.createDataFrame([("qa", 5)], metrics.schema)).first()["samples"] == 5


def test_embeddings(spark, tmp_path):
    kind = "chunk_id string, chunk_index int, cell_start int, text string"
    chunks = spark.createDataFrame([("a", 1, 0, "one"), ("b", 0, 0, "two"), ("c", 2, 0, "three")], kind)
    cache = spark.createDataFrame([("a", None, [1.0]), ("b", "other", [2.0])], "chunk_id string, text_hash string, embedding array<double>")
    got = {r["chunk_id"]: r["embedding"] for r in search.embed(chunks, 4, cache=cache).collect()}
    assert got["a"] == [1.0] and len(got["b"]) == 4 and np.isclose(np.linalg.norm(got["c"]), 1)
    assert [r["chunk_id"] for r in search.in_output_order(search.embed(chunks, 4, limit=2)).collect()] == ["b", "a"]
    index.write_embeddings(search.embed(chunks, 4), str(tmp_path / "e"), "hash", 4)
    assert {tuple(r["embedding"]) for r in search.embed(chunks, backend=lambda t: F.array(F.length(t).cast("double"))).collect()} == {(3.0,), (5.0,)}
    assert files.read_embeddings(spark, jsonl=str(tmp_path / "e/*")).count() == 3
    with pytest.raises(ValueError):
        files.read_embeddings(spark)
    hits = spark.createDataFrame([("a", 0.5), ("z", 0.4)], "chunk_id string, score double")
    assert [r["chunk_id"] for r in search.join_hits(hits, chunks).collect()] == ["a"]


def test_dense_search_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    v, q = np.round(rng.normal(size=(300, 5)), 1), np.round(rng.normal(size=(7, 5)), 1)
    v[5] = v[6] = v[7]
    vectors = spark.createDataFrame([*((i, x.tolist()) for i, x in enumerate(v)), (900, None), (901, [])], "id long, embedding array<double>")
    asked = spark.createDataFrame([*((i, x.tolist()) for i, x in enumerate(q)), (99, None)], "query_id long, query_embedding array<double>")
    for similarity, s in ((T.dot, v @ q.T), (T.cosine, (v / np.linalg.norm(v, axis=1, keepdims=True)) @ (q / np.linalg.norm(q, axis=1, keepdims=True)).T)):
        want = sorted((j, i, n) for j in range(7) for n, (_, i) in enumerate(sorted([*((-round(s[i, j], 6) + 0.0, i) for i in range(300)), (0.0, 901)])[:20], 1))
        got = sorted((r["query_id"], r["id"], r["rank"]) for r in search.dense_top_k(vectors, asked, 20, "id", "query_id", similarity).collect())
        assert got == want
    assert search.dense_top_k(vectors, asked.limit(0), 3, "id", "query_id").count() == 0


def test_bench(spark, tmp_path):
    (tmp_path / "g" / "r" / "a").mkdir(parents=True)
    (tmp_path / "g" / "r" / "a.txt").write_text("a c d")
    (tmp_path / "g" / "r" / "a" / "page_0002.txt").write_text("zwei")
    (tmp_path / "g" / "b").mkdir()
    (tmp_path / "g" / "b" / "page_0001.txt").write_text("x y")
    gold = files.gold_texts(spark, str(tmp_path / "g"))
    assert sorted((r["rel"], r["page"]) for r in gold.collect() if r["page"] is not None) == [("b", 0), ("r/a", 1)]
    rows = spark.createDataFrame([("r/a", "a b"), ("b", "x y"), ("none", "q")], "rel string, text string")
    got = {r["rel"]: r for r in bench.with_gold(rows, gold).collect()}
    assert got["r/a"]["wer"] == pytest.approx(2 / 3) and got["b"]["cer"] == 0 and got["none"]["cer"] is None and got["none"]["wer"] is None
    pages = bench.page_rows(spark.createDataFrame([("r/a", 1, "zwei drei")], "rel string, page int, text string"), gold)
    assert {(r["rel"], r["page"], r["precision_page"], r["compression_ratio"]) for r in pages.collect()} == {("r/a", 1, 0.0, 0.5), ("b", 0, 0.0, 0.0)}
    assert bench.bench_rows(rows, pages).groupBy("row_type").count().count() == 2
    found = cells.cells(spark.createDataFrame([(1, "a\nb\nc\nd")], "doc_id long, text string"))
    sweep = {r["budget"]: r["count"] for r in bench.budget_sweep(found, [None, 2, 9]).groupBy("budget").count().collect()}
    assert sweep == {None: 4, 2: 2, 9: 4}
    measured = spark.createDataFrame([(float(i), i, 2) for i in range(1, 5)], "savings double, ms int, pages int")
    r = bench.corpus_rollup(measured, pages="pages", memory="ms").first()
    assert (r["median_value"], r["p50"], r["p95"], r["max_memory"]) == (3.0, 3.0, 4.0, 4) and r["pages_per_s"] == pytest.approx(np.mean([2000 / i for i in range(1, 5)]))
    assert bench.corpus_rollup(measured.limit(0)).first()["p95"] == 0.0
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (rng.choice(list("abc"), rng.integers(0, 9)).tolist() for _ in range(2))
        table = np.arange(len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(table[j] + 1, new[-1] + 1, table[j - 1] + (x != y)))
            table = np.array(new)
        assert bench.word_distance(a, b) == table[-1]


def test_small_pieces(spark):
    assert files.unit_list("KG\n# all\n mg # small\n\nkg") == ["kg", "mg"]
    made = files.synthetic_reports(spark, 5, 3).collect()
    assert made == files.synthetic_reports(spark, 5, 3).collect() and made[0]["text"].startswith("# Report 1\n\nRevenue: $") and made != files.synthetic_reports(spark, 5, 4).collect()
    assert "notes.conf" and one(spark, files.file_format(F.col("p")), p="/x/A.CONF") == "ini" and one(spark, files.file_format(F.col("p")), p="/x/a.csv.gz") == "csv"
    s = spark.createDataFrame([("q", "a"), ("r", "b")], "sample_id string, doc_id string")
    titles = spark.createDataFrame([("a", "Title"), ("b", " ")], "doc_id string, title string")
    assert {r["sample_id"]: r["label"] for r in samples.with_labels(s, titles).collect()} == {"q": "Title", "r": "b"}
    assert one(spark, samples.qa_prompt(F.col("c")), c="ctx").startswith("Here is a fragment of a document:\nctx\n\nGenerate") and "Heading: (untitled)\n\nx" in one(spark, samples.summary_prompt(F.lit(None).cast("string"), F.col("c")), c="x")
    alerts = spark.createDataFrame([(1, 0, 1, 1, "kg", "s", "HashMismatch"), (1, 2, 1, 1, "", "s", "MissingCell")], "doc_id long, z int, y int, x int, units string, sha1 string, issue string")
    assert cells.alert_summary(alerts).first()["summary"] == "HashMismatch@z0:kg, MissingCell@z2:"
    found = cells.cells(spark.createDataFrame([(1, "5 kg")], "doc_id long, text string"))
    guards = spark.createDataFrame([(1, 9, 64, 64, "kg", "s"), (1, 0, 64, 64, "lb", "s")], "doc_id long, z int, x int, y int, units string, sha1 string")
    assert {r["issue"] for r in cells.verify_guards(guards, found, ["kg"]).collect()} == {"MissingCell", "UnitNotAllowed"}


def test_streams(spark, tmp_path):
    when = lambda h: f"2024-01-01 {h:02d}:00:00"

    def batch(name, rows):
        spark.createDataFrame(rows, "doc_id string, text string, t string").select("doc_id", "text", F.to_timestamp("t").alias("arrived")).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    batch("one", [("a", "first line\nsecond", when(1)), ("b", "PAGE HEAD", when(2))])
    source, target, check = (str(tmp_path / x) for x in ("in/*", "out", "check"))
    streaming.ingest(spark, source, target, check).awaitTermination()
    assert spark.read.parquet(target).count() == 3
    batch("two", [("a", "first line\nsecond", when(3)), ("c", "third", when(4))])
    streaming.ingest(spark, source, target, check).awaitTermination()
    assert sorted(r["doc_id"] for r in spark.read.parquet(target).select("doc_id").distinct().collect()) == ["a", "b", "c"] and spark.read.parquet(target).where("doc_id = 'a'").count() == 2
    q = streaming.arrivals(spark, source, "1 hour", "1 hour").writeStream.format("memory").queryName("arrived_docs").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    first = spark.table("arrived_docs").count()
    batch("three", [("late", "x", when(0)), ("d", "yy", "2024-01-02 09:00:00")])
    q = streaming.arrivals(spark, source, "1 hour", "1 hour").writeStream.format("memory").queryName("arrived_docs2").outputMode("append").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert first >= 1 and spark.table("arrived_docs2").count() >= first
