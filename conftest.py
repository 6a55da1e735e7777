import os
import sys

HERE = os.path.dirname(os.path.abspath(__file__))
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, *filter(None, [os.environ.get("PYTHONPATH")])])
if HERE not in sys.path:
    sys.path.insert(0, HERE)
