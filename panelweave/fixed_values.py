"""Column names, lists and parameters that results depend on.

Everything in this module is data. It must equal what existing users of these
tables rely on, so it is stated plainly and in natural order.
"""

# --- dates and parameters -------------------------------------------------
CUTOFF_DATE = "2025-07-01"
DATE_FORMAT = "yyyy-MM-dd"
TRANSPORT_COST_EUR_KG = 0.3
HORIZONS = (3, 6, 9)

# horizon -> lags, rolling windows, rate-of-change periods
HORIZON_LAGS = {
    3: (1, 2, 3, 6, 9, 12),
    6: (1, 2, 3, 6, 12, 18),
    9: (1, 2, 3, 6, 9, 12, 18, 24),
}
HORIZON_WINDOWS = {3: (3, 6, 12), 6: (3, 6, 12), 9: (6, 12, 24)}
HORIZON_ROC = {3: (3, 6), 6: (6, 9), 9: (9, 12)}
DIFF_PERIODS = (1, 12)

# --- regions, types, units ------------------------------------------------
EUROPE = "europe"
ASIA = "asia"
REGION_PREFIX = {EUROPE: "eu_", ASIA: "asia_"}
TARGET_TYPES = (
    "crystal",
    "white",
    "gf10",
    "gf20",
    "recycled_gf10_white",
    "recycled_gf10_grey",
    "si",
)
REGULAR_TARGET_TYPES = ("crystal", "white", "gf10", "gf20", "si")
GREEN_TARGET_TYPES = ("recycled_gf10_white", "recycled_gf10_grey")
REGULAR = "regular"
GREEN = "green"
RMB_T = "rmb/t"
RMB_KG = "rmb/kg"
USD_KG = "usd/kg"
USD_T = "usd/t"
INR_KG = "inr/kg"
RMB_THRESHOLD = 100.0
USD_THRESHOLD = 10.0
# Order matters: the first type that fits wins.
ASIA_TYPE_ORDER = (
    "gp recycled",
    "gf10fr",
    "gf recycled",
    "si recycled",
    "gp",
    "gf",
    "fr",
    "nat",
    "si",
    "gf fr",
)

# --- exogenous monthly series ---------------------------------------------
EXOGENOUS_COLUMNS = (
    "bpa_capacity_loss_kt",
    "new_passenger_car_registration",
    "min_price_eur_mwhe",
    "max_price_eur_mwhe",
    "avg_price_eur_mwhe",
    "median_price_eur_mwhe",
    "std_price_eur_mwhe",
    "acetone_capacity_loss_kt",
    "phenol_capacity_loss_kt",
    "crude_oil_brent_eur_bbl",
    "benzene_eur_metric_ton",
)

# --- endogenous columns ---------------------------------------------------
BASE_ENDOGENOUS_COLUMNS = (
    "eu_pc_regular_best_price",
    "eu_pc_green_best_price",
    "asia_pc_regular_best_price",
    "asia_pc_green_best_price",
)

# --- Europe price file (names after header cleaning) ----------------------
EU_REFERENCE_COLUMNS = (
    "pc pie",
    "pc pie normalized",
    "pc icis",
    "pc icis normalized",
    "pc pie aligned jan 13",
    "pc gf aligned jan 13",
)
EU_SPREAD_COLUMNS = ("spread oil / benzene", "spread benzene / bpa", "spread bpa / pc")
EU_TYPE_COLUMNS = {
    "crystal": (
        "eu_supplier_1 pc crystal",
        "eu_supplier_2- pc crystal",
        "eu_supplier_3 - pc crystal",
        "eu_supplier_4 - pc crystal",
        "eu_supplier_5 - pc crystal",
    ),
    "white": (
        "eu_supplier_1 - pc white",
        "eu_supplier_1 - pc white.1",
        "eu_supplier_2 - pc white",
        "eu_supplier_3 - pc white",
        "eu_supplier_5 - pc white",
        "eu_supplier_6 - pc white",
    ),
    "gf10": (
        "eu_supplier_1 pc gf 10 fr",
        "eu_supplier_1 pc gf 10 fr.1",
        "eu_supplier_2 pc gf10fr",
        "eu_supplier_3 pc gf10 fr",
        "eu_supplier_4 pc gf10 fr",
        "eu_supplier_7 pc gf10fr",
        "eu_supplier_9 pc gf10 fr",
    ),
    "gf20": ("eu_supplier_2 pc gf20", "eu_supplier_7 pcgf20"),
    "recycled_gf10_white": (
        "eu_supplier_5 recyclé pc gf10 white",
        "eu_supplier_8 recyclé pc gf10 white",
    ),
    "recycled_gf10_grey": (
        "eu_supplier_5 recyclé pc gf10 grey1",
        "eu_supplier_8 recyclé pc gf10 grey1",
    ),
    "si": (
        "eu_supplier_2 pc siloxane",
        "eu_supplier_2 pc siloxane.1",
        "eu_supplier_4 pc si",
        "eu_supplier_4 pc si.1",
        "eu_supplier_7 pc si",
    ),
}

# --- Asia price file (names after header cleaning) ------------------------
ASIA_RATE_RMB = "usd/rmb"
ASIA_RATE_INR = "usd/inr"
ASIA_RATE_EUR = "usd/eur"
ASIA_REFERENCE_COLUMNS = ("pc icis (usd)", "pc chemsino (usd)", "pc tecnon (usd)")
ASIA_SPREAD_COLUMNS = (
    "spread oil / benzene (chemsino)",
    "spread benzene (chemsino)/ bpa (chemsino)",
    "spread bpa (chemsino) / pc (chemsino)",
    "spread oil / benzene (icis)",
    "spread benzene (icis)/ bpa (chemsino)",
    "spread bpa (chemsino) / pc (icis)",
)
# price column -> unit its values are declared in
ASIA_COLUMN_UNITS = {
    "asia_supplier_1 pc gp (rmb/t)": RMB_T,
    "asia_supplier_2 pc gp (rmb/t)": RMB_T,
    "asia_supplier_3 pc gp (rmb/kg)": RMB_T,
    "asia_supplier_1 pc gp (usd/kg)": USD_KG,
    "asia_supplier_2 pc gp (usd/kg)": USD_KG,
    "asia_supplier_2 pc gp (usd/kg).1": USD_KG,
    "asia_supplier_1 pc gp": USD_KG,
    "asia_supplier_7  pc gp": INR_KG,
    "asia_supplier_1 pc gp recycled (rmb/t)": RMB_T,
    "asia_supplier_2 pc gp recycled (rmb/t)": RMB_T,
    "asia_supplier_3 pc gp recycled rmb/t)": RMB_T,
    "asia_supplier_4 pc gp recycled (rmb/t)": RMB_T,
    "asia_supplier_1 pc gp recycled (usd/kg)": USD_KG,
    "asia_supplier_1 pc fr": RMB_KG,
    "asia_supplier_2 pc fr": RMB_KG,
    "asia_supplier_4 pc fr": RMB_KG,
    "asia_supplier_5 pc fr": RMB_KG,
    "asia_supplier_1 usd/kg pc fr": USD_KG,
    "asia_supplier_2 pc fr usd/kg": USD_KG,
    "asia_supplier_2 pc fr usd/kg.1": USD_KG,
    "asia_supplier_5  pc fr usd/kg": USD_KG,
    "asia_supplier_1  pc gf (rmb/t)": RMB_T,
    "asia_supplier_2  pc gf10fr (rmb/t)": RMB_T,
    "asia_supplier_1  pc gf recycled (rmb/t)": RMB_KG,
    "asia_supplier_5 pc gf": RMB_T,
    "asia_supplier_1 pc gf (usd/kg)": USD_T,
    "asia_supplier_1 pc gf (usd/kg).1": USD_KG,
    "asia_supplier_1 pc gf (inr/kg)": INR_KG,
    "asia_supplier_1 pc gf (inr/kg).1": INR_KG,
    "asia_supplier_2 pc gf (inr/kg)": INR_KG,
    "asia_supplier_7 pc gf fr": INR_KG,
    "pc gf10_20 fr _ china _  cnyperton": RMB_T,
    "asia_supplier_1 pc nat": USD_KG,
    "asia_supplier_2 pc nat": USD_KG,
    "pc si (inr/kg)": INR_KG,
    "pc si (rmb/kg)": RMB_KG,
    "pc si recycled (rmb/kg)": RMB_KG,
    "asia_supplier_5 pc si recycled (rmb/kg)": RMB_KG,
    "asia_supplier_4  (usd/kg)": USD_KG,
}
# converted names behind each best price
ASIA_TYPE_COLUMNS = {
    "gp": (
        "asia_supplier_1 pc gp (usd/kg)",
        "asia_supplier_2 pc gp (usd/kg)",
        "asia_supplier_3 pc gp (usd/kg)",
        "asia_supplier_7 pc gp (usd/kg)",
    ),
    "gp_recycled": (
        "asia_supplier_1 pc gp recycled (usd/kg)",
        "asia_supplier_2 pc gp recycled (usd/kg)",
        "asia_supplier_3 pc gp recycled (usd/kg)",
        "asia_supplier_4 pc gp recycled (usd/kg)",
    ),
    "fr": (
        "asia_supplier_1 pc fr (usd/kg)",
        "asia_supplier_2 pc fr (usd/kg)",
        "asia_supplier_4 pc fr (usd/kg)",
        "asia_supplier_5 pc fr (usd/kg)",
    ),
    "gf": (
        "asia_supplier_1 pc gf (usd/kg)",
        "asia_supplier_2 pc gf (usd/kg)",
        "asia_supplier_5 pc gf (usd/kg)",
        "asia_supplier_7 pc gf (usd/kg)",
        "asia_supplier_2 pc gf10fr (usd/kg)",
    ),
    "gf_recycled": ("asia_supplier_1 pc gf recycled (usd/kg)",),
    "nat": ("asia_supplier_1 pc nat (usd/kg)", "asia_supplier_2 pc nat (usd/kg)"),
    "si": ("pc si (usd/kg)",),
    "si_recycled": (
        "asia_supplier_5 pc si recycled (usd/kg)",
        "pc si recycled (usd/kg)",
    ),
}
ASIA_REGULAR_TYPES = ("gp", "fr", "gf", "nat", "si")
ASIA_GREEN_TYPES = ("gp_recycled", "si_recycled", "gf_recycled")

# --- other raw files ------------------------------------------------------
RATE_DATE = "observation_date"
RATE_RMB = "DEXCHUS"
RATE_INR = "DEXINUS"
RATE_EUR = "DEXUSEU"
ELECTRICITY_RENAMES = {
    "country": "country",
    "iso3 code": "iso3_code",
    "date": "date",
    "price (eur/mwhe)": "price_eur_mwhe",
}
REGISTRATION_RAW = "new passenger car registration (car.m.i9.y.creg.pc0000.4f0.n.pn)"
REGISTRATION = "new_passenger_car_registration"
OUTAGE_START = "Outage Start Date"
OUTAGE_END = "Outage End Date"
OUTAGE_LOSS = "Total Capacity Loss (kt)"
DERIVATIVE = "Derivative"
BPA_ROW = "BISPHENOL A"
GRID_DATE_ROW = 8
GRID_ROWS = {14: "crude_oil_brent_eur_bbl", 25: "benzene_eur_metric_ton"}
GRID_FIRST_COL = 2

# --- model and score parameters -------------------------------------------
TIME_INDEX_DAYS = 30.44
MAPE_FLOOR = 2.220446049250313e-16
VARIANCE_THRESHOLD = 1e-4
STATIONARITY_ALPHA = 0.05
MIN_SERIES_SAMPLES = 24
# Coefficients of the published response surface for unit-root p-values (constant, one series):
# powers of the statistic from 0 up, and the least, switching and greatest statistic.
UNIT_ROOT_LOW = (2.1659, 1.4412, 0.038269)
UNIT_ROOT_HIGH = (1.7339, 0.93202, -0.12745, -0.010368)
UNIT_ROOT_RANGE = (-18.83, -1.61, 2.74)
MIN_TRAIN_SAMPLES = 10
LASSO_COEF_THRESHOLD = 1e-8
REGION_WEIGHT = 1.5

# --- product pricing ------------------------------------------------------
PRODUCT_WEIGHT_KG = 0.07686
PRODUCT_CONTENT_SHARE = 0.449
REFERENCE_PRICE = 2.15
BASE_COST = 1.80
SENSITIVITY = {REGULAR: 0.10, GREEN: 0.20}
MARKUP = {"base": 0.15, "premium": 0.25}
