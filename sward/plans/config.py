"""Job parameters with their defaults."""

from dataclasses import dataclass, field

from sward.operators.models import ModelConfig


@dataclass(frozen=True)
class DatasetConfig:
    level: int = 3
    min_year: int = 0
    occurrences: int = 10
    countries: object = "all"
    name_normalisation: bool = True
    folds: int = 10
    east_km: float = 10.0
    north_km: float = 10.0
    location_features: bool = True
    seed: int = 123
    # Digits that sums of cover are rounded to before comparisons.
    cover_digits: int = 6


@dataclass(frozen=True)
class PreprocessConfig:
    standardization: bool = True
    binarization: bool = False
    noise: bool = False
    normalization: bool = False
    log: bool = False
    rank: bool = False
    augmentation: bool = False
    endangered: bool = False
    rare: bool = False
    dropout: float = 0.0
    features: object = "all"
    seed: int = 123

    def __post_init__(self):
        if self.rank and self.binarization:
            raise ValueError("ranks are at most 1, so binarising them removes every species")


@dataclass(frozen=True)
class EvaluationConfig:
    average: str = "micro"
    k: int = 1
    n_folds: int = 10
    # Folds fitted at the same time; each fit is a distributed job of its own.
    parallel: int = 4
    model: ModelConfig = field(default_factory=ModelConfig)
    preprocess: PreprocessConfig = field(default_factory=PreprocessConfig)
