"""Writes the skeleton of a new study: python -m gristmill.plans.scaffold FOLDER NAME"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from .process import Prereg

FILES = {
    "README.md": "# {name}\n\nState the claim in prereg.json before looking at any number, then run `bash run_study.sh`.\n",
    "STATUS.md": "# Status\n\n- [ ] claim frozen\n- [ ] panel built\n- [ ] verdict read\n",
    "requirements.txt": "pyspark\npandas\npyarrow\nnumpy\n",
    ".gitignore": "panel/\nspark-warehouse/\n__pycache__/\n",
    "build_panel.py": '"""Writes panel/: t, date, asset, signal, ret, mask on a dense grid."""\n\nfrom pyspark.sql import SparkSession\n\nfrom gristmill.sources.panel import grid\n\nspark = SparkSession.builder.getOrCreate()\nraise SystemExit("read the facts, call grid(facts, assets), write panel/")\n',
    "judge.py": '"""Runs the battery over panel/ and writes report.json."""\n\nfrom pyspark.sql import SparkSession\n\nfrom gristmill.plans.battery import Study, run\nfrom gristmill.plans.process import Prereg\n\nspark = SparkSession.builder.getOrCreate()\nreport = run(Study("{name}", spark.read.parquet("panel")), Prereg.load("frozen.json"))\nreport.to_json("report.json")\nprint(report)\n',
    "freeze.py": '"""Freezes prereg.json as frozen.json, once."""\n\nimport json\n\nfrom gristmill.plans.process import Prereg\n\nprint(Prereg(**json.load(open("prereg.json"))).freeze("frozen.json"))\n',
    "reproduce.py": '"""Runs the study twice and compares the reports."""\n\nimport json\nimport subprocess\n\nruns = []\nfor _ in range(2):\n    subprocess.run(["python", "judge.py"], check=True)\n    runs.append([{{k: c[k] for k in ("id", "outcome")}} for c in json.load(open("report.json"))["checks"]])\nprint("same" if runs[0] == runs[1] else "different")\n',
    "run_study.sh": "set -e\npython freeze.py\npython build_panel.py\npython judge.py\n",
}


def create(path: str, name: str, force: bool = False) -> list[str]:
    """Writes the files and returns their names; refuses a folder that holds anything, unless forced."""
    root = Path(path)
    if root.exists() and any(root.iterdir()) and not force:
        raise FileExistsError(f"{root} is not empty")
    root.mkdir(parents=True, exist_ok=True)
    for file, text in FILES.items():
        (root / file).write_text(text.format(name=name) if file not in ("build_panel.py", "freeze.py") else text)
    body = {k: v for k, v in vars(Prereg(claim=name)).items() if k != "created_utc"}
    (root / "prereg.json").write_text(json.dumps(body, indent=1))
    return sorted([*FILES, "prereg.json"])


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("folder")
    p.add_argument("name")
    p.add_argument("--force", action="store_true")
    a = p.parse_args()
    print("\n".join(create(a.folder, a.name, a.force)))


if __name__ == "__main__":
    main()
