"""What the operators broadcast can be used where this package is not installed."""

import subprocess
import sys

import numpy as np
import pytest

from tidings.llm import common, decontamination, quality_classifier

USES = {
    "ranking": (
        quality_classifier.Ranking(np.zeros(3), np.ones(3), np.ones(3), 0.0),
        "import numpy as np; print(len(value.scores(np.ones((2, 3)))))",
        "2",
    ),
    "automaton": (
        decontamination.ItemAutomaton([("a", b"one two three")], 3),
        "print(sorted(value.match([b'x', b'one', b'two', b'three'])[1]))",
        "['a']",
    ),
}


@pytest.mark.parametrize("name", USES)
def test_broadcast_objects_need_no_package(spark, tmp_path, name):
    value, use, printed = USES[name]
    sent = common.shipped(spark, value)
    assert type(common.unpacked(sent)).__name__ == type(value).__name__
    (tmp_path / "sent").write_bytes(sent.value)
    code = f"import pickle; value = pickle.load(open({str(tmp_path / 'sent')!r}, 'rb')); {use}"
    hidden = "import sys; sys.modules['tidings'] = None; "
    done = subprocess.run([sys.executable, "-c", hidden + code], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert done.stdout.strip() == printed, done.stderr
