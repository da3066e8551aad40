from tests.test_foreign_folder import run_elsewhere


def test_operators_with_python_workers(tmp_path):
    run_elsewhere(tmp_path, ["op5_pii", "op6_secrets", "op7_ngram_join", "op8_warc", "op9_toxicity", "op10_decontam", "pipeline"])
