"""What to build: one frozen dataclass and the named presets."""

from __future__ import annotations

from dataclasses import dataclass, replace

# The seed and the train share of the uniform split.
SPLIT_SEED = 1729
TRAIN_SHARE = 0.85


@dataclass(frozen=True)
class CorpusConfig:
    name: str = "all"
    metadata_path: str | None = None
    documents_dir: str | None = None
    ipc_prefix: str | None = None
    cpc_prefix: str | None = None
    query: str | None = None
    years: tuple[int, ...] | None = None
    train_start: str | None = None
    train_end: str | None = None
    val_start: str | None = None
    val_end: str | None = None
    uniform_split: bool = False
    balance_validation: bool = False
    drop_last: bool = False
    seed: int = SPLIT_SEED
    train_share: float = TRAIN_SHARE
    decision_from: str = "document"
    section: str = "claims"
    max_length: int = 512
    vocab_size: int = 10_000
    min_frequency: int = 3

    def __post_init__(self):
        if self.decision_from not in ("document", "metadata"):
            raise ValueError(f"decision_from must be 'document' or 'metadata', got {self.decision_from!r}")
        if not 0.0 < self.train_share < 1.0:
            raise ValueError("train_share must lie between 0 and 1")


# ``sample`` points to one month of filings, enough to try things out; ``all`` to every filing year.
PRESETS = {
    "sample": CorpusConfig(
        name="sample",
        metadata_path="./metadata_jan16.feather",
        documents_dir="./data",
    ),
    "all": CorpusConfig(
        name="all",
        metadata_path="./metadata.feather",
        documents_dir="./data",
    ),
}


def evaluation(config: CorpusConfig) -> CorpusConfig:
    """The validation preset: all years, a fixed filing window, uniform split, balanced classes."""
    return replace(
        config,
        name="all",
        metadata_path=PRESETS["all"].metadata_path,
        documents_dir=PRESETS["all"].documents_dir,
        train_start="2015-01-01",
        val_end="2015-2-15",
        uniform_split=True,
        balance_validation=True,
    )


def needed_years(config: CorpusConfig) -> list[int] | None:
    """Filing years that the windows of a configuration touch, to prune partitions; None: any year.

    A uniform split, or bounds without an end of training, is one window; otherwise training and validation are one each. A
    window that is open on one side touches years without end.
    """
    if config.uniform_split or config.train_end is None:
        windows = [(config.train_start, config.val_end)]
    else:
        windows = [(config.train_start, config.train_end), (config.val_start or config.train_end, config.val_end)]
    if any(bound is None for window in windows for bound in window):
        return None
    return sorted({year for first, last in windows for year in range(int(first[:4]), int(last[:4]) + 1)})
