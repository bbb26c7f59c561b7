"""Packed arrays."""

import numpy as np
from pyspark import cloudpickle

from razao.llm import blobs


def test_functions_travel_after_use_on_the_driver():
    cell = blobs.pack(np.arange(5))
    assert blobs._codec
    unpack = cloudpickle.loads(cloudpickle.dumps(blobs.unpack))
    assert unpack(cell, "int64")[0].tolist() == [0, 1, 2, 3, 4]
