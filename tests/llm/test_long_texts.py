"""One text of 100 MB, with each operator that reads texts in Python: what its process takes at most."""

import os
import subprocess
import sys

import pytest

import millrace

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(millrace.__file__)))

HEAD = f"""
import resource, sys
sys.path.insert(0, {ROOT!r})
import numpy as np
import pyarrow as pa
draw = np.random.default_rng(0)
vocabulary = np.array(["".join(chr(97 + x) for x in draw.integers(0, 26, draw.integers(2, 9))) for _ in range(5000)])
piece = " ".join(vocabulary[draw.integers(0, 5000, 200_000)]) + ". "
text = piece * (100_000_000 // len(piece))
"""

READ = {
    "toxicity": """
from millrace.llm.toxicity import Grammar
assert Grammar({"idiot": 3.0}, {"zurg": 2.0}).clauses(text)[0] == text.count(".")
""",
    "shingles": """
from millrace.llm.near import Near, Powers, minhash, shingles
found = shingles(text, Near(), Powers())
assert len(found) == 200_000 and len(minhash(found, Near())) == 96
""",
    "telephony": """
from millrace.llm import telephony as tel
raw = text.encode()
raw += bytes(-len(raw) % 64)
size = len(raw)
row = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([size]), pa.array([tel.wav_header(tel.MULAW, 8000, size, size) + raw], pa.binary())], names=["doc_id", "n_bytes", "media"])
del raw
names = ["doc_id", "n_bytes", "payload_bytes"]
done = list(tel.heard(tel.pcm_rows(tel.described(iter([row]), "doc_id", "media"), "media", "pcm", tel.SEGMENT), names))
assert len(done) == 1 and done[0].column("payload_bytes")[0].as_py() == size and done[0].column("pcm_bytes")[0].as_py() > 4 * size
""",
    "pieces": """
import public_tokenizers
from millrace.llm.sentencepieces import PieceCodec
table = PieceCodec(public_tokenizers.path("piece_bpe_32k.model")).open()
ids = table.encode(text)
assert sum(map(len, table.decoded(ids))) == len(text)
""",
}


@pytest.mark.parametrize("name", READ)
def test_a_text_of_100_mb(name):
    script = HEAD + READ[name] + "print('MB', resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=400)
    assert "MB" in done.stdout, done.stderr[-2000:]
    assert int(done.stdout.split()[-1]) < 1000
