import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = "import sys\nfor name in sys.argv[1:]: sys.modules[name] = None\nimport __spark_entry__ as e\nprint(*e.queries())\nprint(*e.oracle_sql())"


@pytest.mark.parametrize("gone", [[], ["public_tokenizers"], ["xxhash"], ["regex"], ["strandframe.llm"], ["strandframe.llm.queries"], ["corpus_pipeline"]])
def test_the_entry_without_what_is_optional(gone):
    done = subprocess.run([sys.executable, "-c", CODE, *gone], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    queries, sql = (set(line.split()) for line in done.stdout.splitlines())
    assert {"count_exact", "suffix_array", "find_mems_all_codes"} <= sql <= queries
    if gone and gone != ["corpus_pipeline"]:
        assert not [q for q in queries if q.startswith("op") and q[2].isdigit()] and "pipeline" not in queries
    assert {q for q in queries if not q[2].isdigit()} - {"pipeline"} == {q for q in sql if not q[2].isdigit()}
