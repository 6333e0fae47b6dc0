"""Settings of a training run."""

from __future__ import annotations

from dataclasses import dataclass

LINE_END = "</s>"
WORD_END = "</w>"


@dataclass(frozen=True)
class Settings:
    """num_merges: merges to learn; dim and lam: width of the vectors and mean of their Poisson draws.

    semantics: ``literal`` repeats the surveyed learner's update rule, phantom
    pairs included; ``canonical`` is textbook byte-pair encoding.
    """

    num_merges: int = 12_288
    dim: int = 128
    lam: float = 1.05
    seed: int = 42
    semantics: str = "literal"

    def __post_init__(self) -> None:
        if self.semantics not in ("literal", "canonical"):
            raise ValueError(f"semantics is 'literal' or 'canonical', not {self.semantics!r}")
        if self.num_merges < 0 or self.dim < 1 or self.lam <= 0:
            raise ValueError("num_merges is 0 or more, dim 1 or more, lam above 0")
