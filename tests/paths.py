from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata"
