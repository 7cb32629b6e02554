"""The pipeline, stage by stage and whole, against plain Python."""

import hashlib
import re

import corpus_pipeline
from tallyforge.llm import mixing, quality, secrets, tokens

from .conftest import prose
from .test_corpus import plain_classes


def test_pipeline(spark, tmp_path):
    key = "AKIA" + "Q7" * 10
    rows = [(k, prose(k, 80 + k) + (f" {key}" if k % 5 == 0 else ""), "en", f"s{k % 4}", 0) for k in range(40)]
    rows += [(100, rows[3][1], "en", "s1", 0), (101, rows[3][1] + " tail", "en", "s1", 0), (102, "too short", "en", "s1", 0), (103, None, None, None, None), (104, "again and again\n" * 50, "en", "s2", 0), (7, rows[7][1], "en", "s3", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    (_, good), (_, one), (_, redact), (_, mix), (_, encode) = corpus_pipeline.STAGES

    kept = good(spark, docs, str(tmp_path))
    want = [r for r in rows if quality.verdicts(quality.measure([r[1] or ""]))[1][0]]
    assert sorted(map(tuple, kept.collect())) == sorted(want)

    single = one(spark, kept, str(tmp_path))
    least = {c for _, c, _ in plain_classes([r[:2] for r in want])}
    assert sorted(r.doc_id for r in single.collect()) == sorted(least)

    clean = redact(spark, single, str(tmp_path))
    text = {r.doc_id: r.text for r in clean.collect()}
    source = {r[0]: r for r in want}
    assert text == {d: secrets.redacted(source[d][1], secrets.all_spans(source[d][1])) for d in least}
    assert not any(key in t for t in text.values())

    mixed = mix(spark, clean, str(tmp_path))
    copies = {r.doc_id: r["__copies"] for r in mixing.mix(clean).collect()}
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(d for d, n in copies.items() for _ in range(n))
    for stage in (kept, single, clean, mixed):
        assert stage.columns == docs.columns

    t = tokens.tokenizer(tokens.vocabulary_path("word_bpe_49k.json"))
    want_ids = {d: t.encode(x, add_special_tokens=False).ids for d, x in text.items()}
    result = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert result == sorted((d, len(want_ids[d]), hashlib.sha256(" ".join(map(str, want_ids[d])).encode()).hexdigest()) for d, n in copies.items() for _ in range(n))
    assert re.match(r"[0-9a-f]{64}", result[0][2])
