"""Parameters of the analyses.

Fixed values: these must equal the ones the original analyses use, so
they are stated here once, in natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values (labels, codes, thresholds of the original analyses) ---
YEARS_6 = (2005, 2010, 2015, 2020, 2021, 2022)
YEARS_5 = (2005, 2010, 2015, 2020, 2022)
COUNTY_IDS = (33, 35, 53, 61)
COUNTY_FIPS = ("033", "035", "053", "061")
COUNTY_NAMES = ("King", "Kitsap", "Pierce", "Snohomish")
COUNTY_ORDER = ("King", "Kitsap", "Pierce", "Snohomish", "Region")

LIMITED = "Limited Industrial"
NON_INDUSTRIAL_GROUP = "z Non-Industrial"   # compared case-insensitively
CORE = "Core Industrial"
CORE_MEMBERS = ("Aviation Operations", "Military Industrial")
IND_TYPES_2023 = ("Core Industrial", "Industrial-Commercial", "Aviation Operations",
                  "Military Industrial", "Limited Industrial")
SEGMENTS_2015 = ("Core Industrial", "Industrial-Commercial", "Aviation Operations", "Military")
NET_FLAGS_2013 = ("vacant", "redevelopable")

SQFT_PER_ACRE = 43560.0
SRID_WGS84 = 4326
SRID_STATE_PLANE = 2285

# land use types left out of net supply; type 6 (parks) only counts inside a MIC
EXCLUDED_USE_TYPES = (2, 7, 8, 19, 22, 23, 29)
EXCLUDED_USE_TYPES_WITH_PARK = (2, 6, 7, 8, 19, 22, 23, 29)
EXCLUDED_USE_TYPES_R = (0, 2, 6, 7, 8, 19, 22, 23, 29)
PARK_USE_TYPE = 6

URBAN_FACTOR_SQL = 0.88
SUBURBAN_FACTOR_SQL = 0.85
CPI_W_APR = 1.39879952
INCOME_BIN_LABELS = ("Under $25,000", "$25,000-$49,999", "$50,000-$74,999",
                     "$75,000-$99,999", "$100,000 or more", "Else / Prefer not to answer")
INCOME_BIN_EDGES = (25000, 50000, 75000, 100000)
NOT_IN_MIC = "Not in a MIC"
RURAL = "Rural"
UNINCORPORATED = "Unincorporated"
PARCEL_SIZE_THRESHOLD = 0.05
FINAL_DEC = -1
N_REPLICATES = 80
MOE_Z = 1.645


@dataclass(frozen=True)
class FlagPreset:
    """Vacant / redevelopable cut-offs on improvement value per square foot."""
    vacant: float
    redevelopable: float


# three presets in use: one-pass SQL, three-update SQL, and the R analysis
PRESET_MYSQL = FlagPreset(0.00162, 8.1)
PRESET_TSQL = FlagPreset(0.01257, 6.28)
PRESET_R = FlagPreset(0.001 * CPI_W_APR, 5.00 * CPI_W_APR)


@dataclass(frozen=True)
class Params:
    """Tunable knobs of a run (all scale settings live here)."""
    cell_size: float = 1000.0           # spatial grid cell for candidate joins (ft)
    band_width: float = 1000.0          # x-band width that bounds per-group overlay work (ft)
    broadcast_max_rows: int = 200_000   # proven bound below which a side is broadcast
    max_band_pieces: int = 4096         # a (group, band) with more edges is split into sub-bands
    urban_deduction: float = 1.0
    suburban_deduction: float = 1.0
    flag_preset: FlagPreset = field(default=PRESET_R)


DEFAULT = Params()
