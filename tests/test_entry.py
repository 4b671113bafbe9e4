"""The entry module, with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_without_the_optional_folder():
    code = (
        "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['sparkloom.llm'] = None\n"
        "import __spark_entry__ as e; q = e.queries(); e.oracle_sql()\n"
        "assert q and not any(x.startswith('op') or x == 'pipeline' for x in q)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
