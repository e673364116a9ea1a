"""Every stage of the corpus pipeline and the whole of it against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from wayfold.llm import decontaminate, packing, quality_model, quality_rules, shared
from wayfold.llm.tokens import PieceEncoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, doc long, hash long, _doc long, _hash string, row int"


def _row(doc_id, text):
    return (doc_id, text, "en", "s", len(text or ""), 1, 2, 3, "x", 4)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with near copies, benchmark passages, junk, nulls, repeated rows and clashing names."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(k, prose(rnd.randint(14, 40))) for k in range(10)]
    rows = [_row(k, prose(rnd.randint(80, 300))) for k in range(100)]
    for k in range(20):  # near copies of documents 0 to 9
        words = rows[k // 2][1].split()
        words[rnd.randrange(len(words))] = "changed"
        rows.append(_row(100 + k, " ".join(words)))
    rows += [_row(130 + k, prose(60) + " " + text + " " + prose(60)) for k, text in items]
    rows += [_row(150, None), _row(151, ""), _row(152, "!!! " * 200), rows[20], rows[20], _row(21, rows[0][1]), _row(None, rows[30][1]), _row(None, prose(90)), _row(160, prose(9_000))]
    rows.append(_row(5, prose(120)))  # an unrelated text with the id of another
    labels = [(k, 1, 0) for k in range(0, 100)] + [(200 + k, 0, 0) for k in range(60)]
    rows += [_row(200 + k, ("BUY $$$ ### " * rnd.randint(10, 60)) + prose(20)) for k in range(60)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def _deduplicated(rows):
    """Groups by the exact similarity of all pairs; of each the least (id, text) stays."""
    sets = [_shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] == sets[b] or common and 1.8 * common >= 0.8 * (len(sets[a]) + len(sets[b])) - 1e-9:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    groups = {}
    for r, k in zip(rows, root, strict=True):
        groups.setdefault(k, []).append(r)
    return groups


def test_near_dedup_keeps_one_of_each_group(spark, folder, docs):
    rows = _rows(docs)
    got = _rows(corpus_pipeline.deduplicate(spark, docs, folder))
    groups = _deduplicated(rows)
    assert len(got) == len(groups) and set(got) <= set(rows)
    for members in groups.values():
        kept = [r for r in got if r in members]
        assert len(kept) == 1 and (kept[0][0] is None) == all(r[0] is None for r in members)
        assert kept[0][0] == min((r[0] for r in members if r[0] is not None), default=None)
    texts = {r[1] for r in got}
    assert [r[1] in texts for r in rows if r[0] == 5] == [True, True]  # two texts with one id


def test_other_stages_equal_plain_python(spark, folder, docs):
    rows = _rows(docs)
    model = quality_model.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))

    def good(text):
        x = np.array([quality_model.statistics((text or "").encode())])
        total = model[0] + sum(w for rule, w in model[1] if quality_model.fires(rule, x)[0])
        return 1 / (1 + np.exp(-total)) >= 0.5

    assert _rows(corpus_pipeline.classify(spark, docs, folder)) == [r for r in rows if good(r[1])]
    assert _rows(corpus_pipeline.rules(spark, docs, folder)) == [r for r in rows if quality_rules.measure((r[1] or "").encode())["kept"]]
    memo = decontaminate.WordHashes()
    items = [decontaminate.word_hashes(r["text"], memo) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaky = lambda t: any(decontaminate.best_run(i, decontaminate.word_hashes(t, memo))[0] <= int(0.2 * len(i)) for i in items)
    assert _rows(corpus_pipeline.decontaminated(spark, docs, folder)) == [r for r in rows if not leaky(r[1])]
    tok = PieceEncoder(shared.default_tokenizer("byte_bpe_50k.json")).tok
    packed = corpus_pipeline.pack(spark, docs, folder).collect()
    lengths = Counter()
    for r in packed:
        lengths[r["doc_id"]] += r["length"]
    want = Counter()
    for r in rows:
        want[r[0]] += len(tok.encode(r[1] or "").ids) + 1
    assert lengths == want


def test_the_whole_pipeline(spark, folder, docs):
    """run() is its stages one after another; each but the last returns the columns of documents."""
    at = docs
    for _, stage in corpus_pipeline.STAGES:
        assert at.columns == docs.columns
        at = shared.materialise(stage(spark, at, folder), "t")
    piece = lambda r: (str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(piece, got)) == sorted(map(piece, at.collect()))
    ids = {r["doc_id"] for r in got}
    assert ids >= {k for k in range(10, 100) if k != 5} - {30} and not ids & {150, 151, 152, *range(100, 120), *range(130, 140), *range(200, 260)}
    assert max(Counter((r["sequence_id"], r["offset"]) for r in got).values()) == 1


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
