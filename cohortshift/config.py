"""Constants that decide results, in one frozen place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    seed: int = 42
    min_family_rows: int = 100
    flag_corr: float = 0.90
    consensus_corr: float = 0.95
    cluster_corr: float = 0.80
    sweep_corr: tuple = (0.90, 0.925, 0.95, 0.975, 0.99)
    split_modulus: int = 1000
    split_test: int = 200
    split_phase: int = 131
    entropy_bins: int = 50
    tukey: float = 1.5
    view_low: float = 0.005
    view_high: float = 0.995
    sentinel_mass: float = 0.01
    zero_inflation: float = 0.10
    nominal_levels: int = 10
    discrete_levels: int = 100
    log_ratio: float = 100.0
    auc_deadband: float = 0.05
    dip_p: float = 0.05
    mode_mass: float = 0.02
    min_modal: int = 100
    max_modes: int = 4
    separation_strong: float = 0.55
    mi_strong: float = 0.05
    excess_cap: float = 10.0
    js_top: int = 50
    qq_r2: float = 0.97
    qq_slope: float = 0.15
    qq_intercept: float = 0.05
    c2st_sample: int = 2000
    c2st_depth: int = 6
    c2st_folds: int = 5
    null_percentile: float = 95.0
    min_slice: int = 20
    min_null: int = 50
    bootstraps: int = 2000
    exposure_draws: int = 5000


CONFIG = Config()
#: Student's t for 4 degrees of freedom at 97.5 %.
T_975_DF4 = 2.7764451051977987
#: The eight families and their codes.
FAMILIES = {"Benign": 0, "Botnet": 1, "BruteForce": 2, "DDoS": 3, "DoS": 4, "Infiltration": 5, "PortScan": 6, "WebAttack": 7}
#: Raw labels, lower case, of each family.
RAW_LABELS = {
    "Benign": ["benign"],
    "DoS": ["dos hulk", "dos goldeneye", "dos slowloris", "dos slowhttptest", "dos attacks-goldeneye", "dos attacks-hulk", "dos attacks-slowhttptest", "dos attacks-slowloris"],
    "DDoS": ["ddos", "ddos attack-hoic", "ddos attack-loic-http", "ddos attacks-loic-http", "ddos-hoic", "ddos-loic-http", "ddos-loic-udp"],
    "BruteForce": ["ssh-patator", "ftp-patator", "ssh-bruteforce", "ftp-bruteforce"],
    "WebAttack": ["web attack -- brute force", "web attack -- xss", "web attack -- sql injection", "brute force -web", "brute force -xss", "sql injection", "xss", "web attack - brute force", "web attack - xss", "web attack - sql", "web attack - sql injection"],
    "Botnet": ["bot", "botnet", "botnet ares"],
    "PortScan": ["portscan"],
    "Infiltration": ["infiltration", "infiltration-cooliot", "infiltration-dropbox", "infiltration-ares", "infiltration - nmap portscan", "infiltration - communication victim attacker", "infiltration - dropbox download", "infiltration - portscan"],
}
#: Generality of detected types and of scales.
TYPE_ORDER = {"identifier": 0, "nominal": 1, "binary": 2, "low-cardinality-discrete": 3, "discrete-count": 4, "continuous": 5}
SCALE_ORDER = {"categorical": 0, "linear": 1, "symlog": 2, "log": 3}
#: Corroboration metrics of each route.
ROUTES = {
    "nominal": ("jensen_shannon", "nominal", "none", "pmf", "whole_distribution"),
    "discrete_count": ("jensen_shannon", "nominal", "none", "pmf", "whole_distribution"),
    "continuous_unimodal": ("wasserstein_qn", "continuous", "none", "quantile_normalization", "whole_distribution"),
    "continuous_multimodal": ("mmd", "continuous", "semantic_or_nearest_center", "quantile_normalization", "per_mode"),
    "structural_change": ("wasserstein_qn", "continuous", "none", "quantile_normalization", "whole_distribution"),
}
#: Name parts of features that can't be negative, and features with a sentinel.
NONNEGATIVE_HINTS = ["length", "count", "duration", "bytes", "packet", "iat", "size", "flags", "total", "mean", "max", "min", "std", "rate", "win", "active", "idle", "subflow", "segment", "bulk"]
SENTINEL_FEATURES = ["icmp code", "icmp type"]
IDENTIFIERS_ML = ["id", "flow id", "src ip", "src port", "dst ip", "dst port", "protocol", "timestamp", "label"]
IDENTIFIERS_DRIFT = ["id", "flow id", "src ip", "src port", "dst ip", "timestamp"]
