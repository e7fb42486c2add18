from dataclasses import FrozenInstanceError

import pytest

from labelmill import PRESETS, CorpusConfig, evaluation, needed_years
from labelmill.session import scratch_path, shared_root


def test_presets_and_evaluation():
    assert set(PRESETS) == {"sample", "all"}
    preset = evaluation(PRESETS["sample"])
    assert (preset.train_start, preset.val_end) == ("2015-01-01", "2015-2-15")
    assert preset.uniform_split and preset.balance_validation and preset.name == "all"
    with pytest.raises(FrozenInstanceError):
        preset.seed = 1


def test_needed_years():
    assert needed_years(CorpusConfig()) is None
    assert needed_years(CorpusConfig(train_start="1995-01-01")) is None
    assert needed_years(CorpusConfig(train_end="1995-01-01", val_end="1996-01-01")) is None
    assert needed_years(CorpusConfig(train_start="2010-01-01", val_end="2012-02-01")) == [2010, 2011, 2012]
    four = CorpusConfig(train_start="2010-05-01", train_end="2011-01-01", val_start="2014-01-01", val_end="2014-12-31")
    assert needed_years(four) == [2010, 2011, 2014]


def test_bad_values():
    with pytest.raises(ValueError):
        CorpusConfig(decision_from="nowhere")
    with pytest.raises(ValueError):
        CorpusConfig(train_share=1.0)


def test_scratch_lies_in_the_configured_folder(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_root(spark) == configured
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second and first.startswith(configured)
