import os
import subprocess
import sys

from helixmart.llm import common as C, decontaminate, tokens, toxicity  # noqa: F401  (their tables register themselves)


def test_one_stage_of_word_tables_at_a_time():
    C.only("words")
    C.WORDS[b"a"]
    C.only("words")
    assert len(C.WORDS) == 1
    toxicity.features("some words")
    C.only("terms")
    assert not C.WORDS and {"words", "terms", "templates", "literals", "encoders"} <= set(C._REMEMBERED)
    C.only()
    assert not toxicity._TERMS


def test_bare_session_stores(tmp_path):
    """Without spark.checkpoint.dir a local session stores in a temporary folder; no setting of a running session changes."""
    code = (
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "from helixmart.llm.common import stored\n"
        "assert stored(s.range(3)).count() == 3 and stored(s.range(4)).count() == 4\n"
        "assert s.conf.get('spark.checkpoint.dir', None) is None\n")
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))}
    subprocess.run([sys.executable, "-c", code], check=True, env=env, timeout=120, capture_output=True)
