"""The pipeline's stages, each against the plain rule it applies to its own input."""

import hashlib

import public_tokenizers
from pyspark.sql import functions as F
from test_decontamination import plain_matches
from test_near_duplicates import brute
from test_text_models import brute_kept, plain_language_id
from tokenizers import Tokenizer

import corpus_pipeline
from colloquy.llm import decontamination, language_id, near_duplicates, quality_rules
from colloquy.llm.common import table


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").cache()
    plain = {
        "language_id": lambda d: ids(language_id.predict(d, language_id.fitted(d, ~language_id.is_held_out())).filter("lang_pred <> 'und' and not (ambiguous and score < 0.5)")),
        "quality_rules": lambda d: ids(quality_rules.apply_rules(d).filter("kept")),
        "near_dedup": lambda d: ids(near_duplicates.near_duplicates(d).filter("kept")),
        "decontamination": lambda d: ids(d.join(decontamination.matches(d, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "doc_id", "left_anti")),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).cache()
        assert out.columns == docs.columns and ids(out) == plain[name](docs), name
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert ids(last) == ids(docs) == ids(corpus_pipeline.run(spark, sf_dir))


def test_odd_rows_pass_every_stage(spark, sf_dir):
    base = table(spark, sf_dir, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (10**6, "x" * 200_000, None, None, None)], base.schema)
    docs = base.unionByName(odd).unionByName(odd).withColumn("score", F.lit("clash")).withColumn("kept", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() > 0, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name


def plain_pipeline(docs, items):
    """The five stages over (doc_id, text, lang) rows in plain Python: no function of the operators, the library for tokens."""
    told = plain_language_id(docs)
    left = [(i, t) for i, t, _ in docs if told[i][0] != "und" and not (told[i][2] < 0.5 and told[i][1] < 0.5)]
    left = [(i, t) for i, t in left if brute_kept(t)]
    groups = brute(left)
    left = [(i, t) for i, t in left if groups[i][1] == i]
    gone = {m[0] for m in plain_matches(left, items)}
    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for i, t in left:
        if i not in gone:
            ids_ = library.encode(t, add_special_tokens=False).ids
            out[i] = (len(ids_), digest(" ".join(map(str, ids_))), digest(library.decode(ids_, skip_special_tokens=False)))
    return out


def test_run_against_plain_python(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    want = plain_pipeline([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows} == want and len(rows) == len(want) < docs.count()


def test_odd_rows_have_their_results(spark, sf_dir):
    """What each stage does with nulls, empty texts, repeated rows and repeated ids."""
    base = table(spark, sf_dir, "documents")
    text = base.orderBy(F.desc("n_chars")).first()["text"]
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (10**6, "x" * 5000, None, None, None), (10**6 + 1, text, "en", "s", 1), (10**6 + 1, text, "en", "s", 1)], base.schema)
    docs = base.unionByName(odd)
    told = corpus_pipeline.language(spark, docs, sf_dir)
    assert {r["doc_id"] for r in told.filter("doc_id is null or doc_id >= 1000000").collect()} <= {10**6, 10**6 + 1} and told.filter("doc_id = 1000001").count() == 2
    good = corpus_pipeline.quality(spark, docs, sf_dir)
    assert good.filter("doc_id is null or doc_id = 1000000").count() == 0 and good.filter("doc_id = 1000001").count() == 2
    left = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert left.filter("doc_id is null").count() == 2 and left.filter("doc_id = 1000000").count() == 1 and left.filter("doc_id = 1000001").count() == 0
    coded = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.tokens(spark, odd, sf_dir).collect()}
    assert coded[None] == 0 and coded[10**6] > 0
