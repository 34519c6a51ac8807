"""The pipeline's stages on planted documents, compared with plain Python."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline as P

RIGHTS = "All rights are reserved by the example company since then"


def _planted():
    """Rows of documents, labels and benchmark, and what each stage leaves: {doc_id: text}."""
    rng = random.Random(11)
    voc = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(3, 8))) for _ in range(500)]
    words = lambda n: [rng.choice(voc) for _ in range(n)]
    said = lambda w: ". ".join(" ".join(w[j:j + 12]) for j in range(0, len(w), 12))
    item = " ".join(words(30))
    texts, toxic, kind = [], [], []
    for i in range(200):
        w = words(60)
        if i % 4 == 0:
            for _ in range(3):
                w.insert(rng.randrange(60), rng.choice(["idiot", "grumpfel"]))
        text, what = said(w), ""
        if i % 4 == 1 and i % 3 == 0:
            text, what = text + "\n" + (RIGHTS if i % 2 else RIGHTS.replace("since", "sinc")) + "\n" + " ".join(words(9)), "line"
        elif i % 20 == 2:
            text, what = f"{text} {item} {' '.join(words(20))}", "leak"
        elif i % 20 == 7:
            text, what = texts[i - 4] + " " + " ".join(words(2)), "copy"
        elif i == 199:
            text, what = RIGHTS, "only line"
        texts.append(text)
        toxic.append(int(i % 4 == 0))
        kind.append(what)
    docs = dict(enumerate(texts))
    stages = [docs := {d: t for d, t in docs.items() if "idiot" not in t and "grumpfel" not in t}]
    seen, left = [], {}
    for d, t in docs.items():
        lines = []
        for line in t.split("\n"):
            near = any(line == s or {line, s} == {RIGHTS, RIGHTS.replace("since", "sinc")} for s in seen)
            seen.append(line)
            lines += [] if near else [line]
        if lines:
            left[d] = "\n".join(lines)
    stages.append(docs := left)
    grams = {d: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in docs.items())}
    ids = list(docs)
    gone = {b for k, b in enumerate(ids) if any(len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]) for a in ids[:k])}
    stages.append(docs := {d: t for d, t in docs.items() if d not in gone})
    stages.append({d: t for d, t in docs.items() if item not in t})
    return texts, toxic, kind, item, stages


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    texts, toxic, kind, item, stages = _planted()
    sf = str(tmp_path_factory.mktemp("planted"))
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1 - x, x) for i, x in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, kind, stages


def test_every_stage_keeps_what_plain_python_keeps(spark, planted):
    sf, kind, stages = planted
    assert [len(s) for s in stages] == sorted({len(s) for s in stages}, reverse=True)       # each stage has its cases
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for (name, stage), want in zip(P.STAGES, stages):
        now = P.written(stage(spark, now, sf), "test-planted")
        assert {r.doc_id: r.text for r in now.collect()} == want, name
        assert now.count() == len(want) and now.where("n_chars <> char_length(text)").count() == 0, name
    left = stages[-1]
    assert not {d for d in left if kind[d] in ("leak", "copy", "only line")} and {d for d in left if kind[d] == "line"}


def test_run_packs_the_ids_of_what_is_left(spark, planted):
    import public_tokenizers
    from tokenizers import Tokenizer
    sf, _, stages = planted
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for d, t in stages[-1].items():
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [2], "<u4")
        assert len(ids) <= 1024
        want.add((d, 0, 0, len(ids), zlib.crc32(ids.tobytes())))
    rows = P.run(spark, sf).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    place = {}
    for r in rows:
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in place.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(s[-1]) <= 1024
