import os
import sys
from pathlib import Path

# Python workers import the package too.
ROOT = str(Path(__file__).resolve().parents[2])
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)
