"""Job options: the parameters of every analysis, frozen."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values taken from the reference job's configuration and code; results
# only match when these defaults are used.
#   excluded codes: 0, 8, 500, 901, 801, 802
#   movement flag kept: "I"
#   sample fraction: 0.05
#   minSupport 0.05, minConfidence 0.5
#   big K 100; optimal k raw 30, pca 38; optimal t raw 7, pca 10
#   k sweep 5..45, t sweep 5..25 (both inclusive)
#   top itemsets per cluster 15; loadings per PC 10
#   PCA variance band 0.80..0.85; K-means seed 1; text segment length 8000
EXCLUDED_CODES = (0, 8, 500, 901, 801, 802)


@dataclass(frozen=True)
class Options:
    sample_fraction: float = 0.05
    excluded_codes: tuple = EXCLUDED_CODES
    flag_value: str = "I"
    min_support: float = 0.05
    min_confidence: float = 0.5
    big_k: int = 100
    opt_k_raw: int = 30
    opt_k_pca: int = 38
    opt_t_raw: int = 7
    opt_t_pca: int = 10
    k_low: int = 5
    k_high: int = 45
    t_low: int = 5
    t_high: int = 25
    top_itemsets: int = 15
    n_loadings: int = 10
    variance_low: float = 0.80
    variance_high: float = 0.85
    seed: int = 1
    segment_length: int = 8000
    #: partitions of the distinct-itemset base that models are fitted on: set it to the cluster's cores
    base_partitions: int = 8

    @property
    def k_values(self) -> list[int]:
        return list(range(self.k_low, self.k_high + 1))

    @property
    def t_values(self) -> list[int]:
        return list(range(self.t_low, self.t_high + 1))
