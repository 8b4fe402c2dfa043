"""The pipeline against a brute-force version of its stages, and stages on odd tables."""

import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from conftest import rows

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from millrace.llm.queries import ORACLES, PIECE_MODEL, QUERIES, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    docs, labels = [], []
    for i in range(240):
        lines = [" ".join(word() for _ in range(rng.randint(6, 12))).capitalize() + "." for _ in range(rng.randint(4, 9))]
        if i % 3 == 0:
            lines.insert(1, "Subscribe to our letter")
        bad = i % 8 == 5
        if bad:
            lines = [x.replace(" ", "%%% ") for x in lines]
        docs.append([i, "\n".join(lines), "en", rng.choice(["s1", "s1", "s2", None]), 0])
        labels.append((i, int(not bad), 0))
    for i in range(240, 260):  # near copies of good documents
        docs.append([i, docs[(i - 240) * 8][1] + " end", "en", "s1", 0])
    docs += [[300, None, None, "s2", None], [301, "", None, "s2", 0], [None, docs[0][1], "en", "s2", 0], [2, docs[2][1], "en", docs[2][3], 0]]
    return [tuple(d) for d in docs], labels


@pytest.fixture
def folder(spark, tmp_path):
    docs, labels = corpus()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_each_stage_is_what_brute_force_makes_of_its_input(spark, folder):
    bad = {i for i, quality, _ in corpus()[1] if not quality}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, folder)
        found.write.parquet(f"{folder}/{name}")
        made[name] = (docs, docs := spark.read.schema(found.schema).parquet(f"{folder}/{name}"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == list(corpus_pipeline.COLUMNS)

    before, after = made["quality classifier"]
    kept = {r["doc_id"] for r in after.collect()}
    assert len(kept & bad) <= 1 and len(set(range(260)) - bad - kept) <= 3

    before, after = made["line dedup"]
    seen = defaultdict(set)
    for r in before.collect():
        for line in (r["text"] or "").split("\n"):
            seen[line.strip(" \t\r\x0b\x0c").lower()].add(r["doc_id"])
    common = {k for k, ids in seen.items() if k and len(ids) >= 10}
    assert common == {"subscribe to our letter"}
    expected = Counter()
    for r in before.collect():
        lines = (r["text"] or "").split("\n")
        text = "\n".join(x for x in lines if x.strip(" \t\r\x0b\x0c").lower() not in common)
        if text or not any(x.strip(" \t\r\x0b\x0c").lower() in common for x in lines):
            expected[r["doc_id"], text] += 1
    assert Counter((r["doc_id"], r["text"]) for r in after.collect()) == expected

    before, after = made["n-gram Jaccard join"]

    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    ids = {r["doc_id"]: grams(r["text"]) for r in before.collect() if r["doc_id"] is not None}
    least = {i: i for i in ids}
    for _ in range(5):
        for a in ids:
            for b in ids:
                if a < b and ids[a] and 100 * len(ids[a] & ids[b]) >= 80 * len(ids[a] | ids[b]):
                    least[a] = least[b] = min(least[a], least[b])
    left = Counter(r["doc_id"] for r in after.collect())
    assert {i for i in left if i is not None} == {i for i in ids if least[i] == i} and set(left.values()) == {1}

    before, after = made["mixing sources to target weights"]
    texts = {r["doc_id"]: r for r in before.collect()}
    copies = Counter(r["doc_id"] for r in after.collect())
    assert max(copies.values()) <= 2 and set(copies) <= set(texts)
    total = sum(len((r["text"] or "").split()) for r in texts.values())
    taken = sum(len((texts[i]["text"] or "").split()) * n for i, n in copies.items())
    assert abs(taken - 1.5 * total) < 0.05 * total

    before, after = made["SentencePiece encoding and decoding"]
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_MODEL))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in after.collect()) == Counter(
        (r["doc_id"], tuple(library.encode(r["text"] or ""))) for r in before.collect()
    )
    assert after.filter("NOT round_trip").count() == 0


def test_run_is_the_stages_in_turn(spark, folder):
    first = rows(corpus_pipeline.run(spark, folder), "doc_id", "n_tokens")
    assert first and first == rows(corpus_pipeline.run(spark, folder), "doc_id", "n_tokens")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_empty_tables_and_extra_columns(spark, folder, name, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "'x' AS score", "1 AS copies", "'t' AS ids", "2 AS n_lines")
    assert stage(spark, docs.limit(0), folder).count() == 0
    assert stage(spark, docs.filter("doc_id < 30"), folder).count() > 0


def test_all_operators_are_registered():
    found = queries()
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES} and set(QUERIES) < set(found)
    assert "pipeline" in found and set(ORACLES) <= set(oracle_sql())


def test_line_dedup_keeps_every_document(spark, folder):
    copies = [(i, "one line\nand another", "en", "s1", 20) for i in range(12)] + [(20, "a text of its own", "en", "s1", 17)]
    found = corpus_pipeline.lines(spark, spark.createDataFrame(copies, SCHEMA), folder)
    assert rows(found, "doc_id", "text", "n_chars") == rows(spark.createDataFrame(
        [(i, "", 0) for i in range(12)] + [(20, "a text of its own", 17)], "doc_id long, text string, n_chars long"
    ))


def test_one_document_of_each_group_stays_whatever_its_id(spark, folder):
    text, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = [(3, text), (None, text), (None, text + " end"), (3, text + " more"), (7, other), (7, other), (None, "alone it is"),
            (None, None), (None, "")]
    df = spark.createDataFrame([(i, t, "en", "s1", 0) for i, t in docs], SCHEMA)
    found = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, df, folder).select("doc_id", "text").collect()]
    assert Counter(i for i, _ in found) == {3: 1, 7: 1, None: 3}
    assert {t for i, t in found if i is None} == {"alone it is", None, ""}


def test_rows_without_an_id_or_of_a_repeated_one_are_mixed_each_for_itself(spark, folder):
    rows_ = [(None, f"free {i} " + "w " * (i % 9), "b") for i in range(100)]
    rows_ += [(i % 5, f"held {i} by several", "b") for i in range(50)] + [(9, "equal rows", "b")] * 30
    rows_ += [(1000 + i, "long words here " * 12, "a") for i in range(60)] + [(2000 + i, "x y z", None) for i in range(400)]
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows_], SCHEMA)
    found = [tuple(r) for r in corpus_pipeline.mixture(spark, df, folder).select("doc_id", "text", "source").collect()]
    size = {s: sum(len(t.split()) for _, t, of in rows_ if of == s) for s in ("a", "b", None)}
    taken = {s: sum(len(t.split()) for _, t, of in found if of == s) for s in size}
    targets = brute_targets(size, {"a": 3, "b": 1, None: 2}, 1.5)
    for s in size:
        assert abs(taken[s] - targets[s]) <= 36, (s, taken, targets)
    given, times = Counter((i, t) for i, t, _ in rows_), Counter((i, t) for i, t, _ in found)
    assert all(times[k] <= 2 * given[k] for k in times) and set(times) <= set(given)


def brute_targets(size, weight, share):
    total, capped = share * sum(size.values()), {}
    while True:
        free = [s for s in size if s not in capped]
        rest = total - sum(capped.values())
        level = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if level[s] > 2 * size[s]]
        if not over:
            return capped | level
        capped |= {s: 2 * size[s] for s in over}
