"""What a session writes for itself goes when its application ends."""

import os
import subprocess
import sys

CODE = """
import sys
from fadeline.session import application_folder, checkpointed, session
spark = session("folders", 1, **{"spark.checkpoint.dir": sys.argv[1]})
spark.sparkContext.setLogLevel("ERROR")
assert checkpointed(spark.range(5)).count() == 5
spark.range(3).write.parquet(application_folder(spark) + "/own")
import os
print(sum(len(f) for _, _, f in os.walk(sys.argv[1])))
spark.stop()
"""


def test_folders_go_at_the_end(tmp_path):
    (tmp_path / "kept").write_text("not ours")
    out = subprocess.run([sys.executable, "-c", CODE, str(tmp_path)], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(__file__)), timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.split()[-1]) > 3
    assert [f for _, _, files in os.walk(tmp_path) for f in files] == ["kept"]
