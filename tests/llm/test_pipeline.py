"""The pipeline against a plain version, stage by stage, and its edges."""

import hashlib
import re

import duckdb
import public_tokenizers
import sentencepiece

import corpus_pipeline
from spindrift.llm import queries as Q
from spindrift.llm.secrets import RULES, redacted

from .test_corpus_operators import brute_fingerprint, groups


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_pipeline(sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{sf_dir}/benchmark.parquet'")
    con.sql(f"CREATE TABLE documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    sql = Q.oracle_sql()
    con.sql(f"CREATE TABLE kept AS SELECT doc_id FROM ({sql['op2_quality_rules']}) WHERE kept")
    con.sql("DELETE FROM documents WHERE doc_id NOT IN (FROM kept)")
    rows = sorted(con.sql("SELECT doc_id, text FROM documents").fetchall())
    prints = [brute_fingerprint(t) for _, t in rows]
    least = groups(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    con.executemany("DELETE FROM documents WHERE doc_id = ?", [[i] for k, (i, _) in enumerate(rows) if least[k] != k] or [[-1]])
    clean = con.sql(f"SELECT doc_id FROM ({sql['op1_decontamination']}) WHERE NOT contaminated").fetchall()
    texts = dict(con.sql("SELECT doc_id, text FROM documents").fetchall())
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = {}
    for (i,) in clean:
        spans = [(m.start(), m.end(), r.kind) for r in RULES for m in re.finditer(r.pattern, texts[i]) if m.end(r.group) - m.start(r.group) >= r.least]
        ids = library.encode(redacted(texts[i], spans, corpus_pipeline.REDACTED))
        out[i] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    return out


def test_pipeline_equals_the_plain_version(spark, sf_dir):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    want = plain_pipeline(sf_dir)
    assert len(want) > 50 and got == want


def test_stages_bear_edges(spark, sf_dir, edges, no_rows):
    for docs in (edges, no_rows):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns, name
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_a_worker_keeps_one_operators_caches(spark, monkeypatch):
    """Workers outlive a stage: what the last stage kept does not stay beside the next one's,
    and the quality rules start with nothing kept."""
    import public_tokenizers
    import pyarrow as pa

    from spindrift.llm.quality import document_features, language_counts
    from spindrift.llm.secrets import RULES, scanner
    from spindrift.llm.sentencepiece_codec import codec

    def keep():
        own = codec(public_tokenizers.path("piece_bpe_32k.model"))
        own.encode("some words")
        assert codec(public_tokenizers.path("piece_bpe_32k.model")) is own

    keep()
    assert codec.cache_info().currsize == 1
    scanner(RULES)
    assert (codec.cache_info().currsize, scanner.cache_info().currsize) == (0, 1)
    docs = spark.createDataFrame([(1, "a b c", "en")], "doc_id long, text string, lang string")
    # What tasks run over Arrow batches is called in this process.
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: f)
    for task in (language_counts(docs, "doc_id", "text", "lang", 1, 20), document_features(docs, [])):
        keep()
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a b c"]), pa.array(["en"])], names=["doc_id", "text", "lang"])
        assert sum(b.num_rows for b in task(iter([batch]))) > 0
        assert codec.cache_info().currsize == 0
