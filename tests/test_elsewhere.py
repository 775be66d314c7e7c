"""Workers need no copy of the package: queries with Python functions run from a folder that is not the repository."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
RUN = """
import sys
sys.path.insert(0, sys.argv[1])
from vellum.session import session
from vellum.plans.queries import QUERIES
spark = session("local[2]", 2, **{"spark.ui.enabled": "false"})
for name in ("tabs_flatten", "drawio_ast", "svg_ast", "plantuml_ast", "plantuml_mermaid", "plantuml_rendered", "rendered_drawing"):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").collect(), name
"""


def test_other_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", RUN, str(REPO)], cwd=tmp_path, env=env, check=True, timeout=300)
