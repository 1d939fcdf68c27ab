"""The registered queries over whole tables: rows, columns and types."""

import pytest

from evalloom.llm import ORACLES, QUERIES

ALL = {
    "op1_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op2_source_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op3_simhash_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op4_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op5_bitsliced_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op6_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op7_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op9_html_text": "page_id bigint, url string, text string, n_chars bigint",
    "op10_lm_score": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op11_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    "op12_chat_windows": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op13_ranked_search": "item_id bigint, rank int, doc_id bigint, score bigint",
}


@pytest.mark.parametrize("name", list(ALL))
def test_results(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    df = QUERIES[name](spark, sf_dir)
    kinds = dict(df.dtypes)
    for column in ALL[name].split(", "):
        field, kind = column.split()
        assert kinds[field] == kind
    rows = df.count()
    if name.startswith("op5"):
        table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        assert rows == 5 * table.where("vec_id % 50 = 0").count()
    elif name.startswith("op11"):
        assert rows == 8 * spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    elif name.startswith("op12"):
        assert rows == 1 + spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()
    elif name.startswith("op13"):
        assert rows == 10 * spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    elif name.startswith("op9"):
        assert rows == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    elif name.startswith("op1_"):
        assert rows >= spark.read.parquet(f"{sf_dir}/documents.parquet").count() == df.where("piece = 0").count()
    else:
        assert rows == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_what_sql_checks():
    assert set(ORACLES) == {"op4_secret_scan", "op5_bitsliced_topk", "op8_quality_rules", "op13_ranked_search"} and set(QUERIES) == set(ALL)
