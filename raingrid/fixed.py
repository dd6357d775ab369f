"""Fixed values. Results only match when these stay exactly as they are."""

# Numeric codes that stand for a missing reading.
SENTINELS = (8888.0, 9999.0)

# Text that stands for a missing reading in station sheets.
SHEET_MISSING = ("-", "nan", "NaN", "NULL", "")

# Text that stands for a missing reading in mooring tokens.
TOKEN_MISSING = (
    "-9", "-9.0", "-9.9", "-9.99", "-9.999",
    "-999", "-999.0", "-999.9", "-999.99", "-999.999",
    "NaN", "nan", "NULL", "null", "",
    "-99", "-99.0", "-99.9", "-99.99", "-99.999",
)

# Exact missing reading per mooring variable.
MOORING_MISSING = {
    "rad": -999.99, "rain": -9.99, "rh": -9.99, "sst": -9.99, "temp": -9.999, "wind": -99.9,
}

# Quality and source digits that pass the filter.
KEEP_QUALITY = (1, 2, 3)
KEEP_SOURCE = (1, 2, 3, 5, 6, 7, 8)
INTERPOLATED_SOURCE = (3, 7, 8)
SOURCE_RANK = {5: 5, 6: 4, 7: 3, 8: 2}
QUALITY_LABEL = {3: "adjusted", 4: "low"}

# Temperature depths kept by default, in metres.
TARGET_DEPTHS = (10.0, 20.0, 40.0, 60.0, 80.0, 100.0, 120.0, 140.0, 180.0, 300.0, 500.0)

# Valid range per station variable.
STATION_LIMITS = {
    "TX": (-5.0, 45.0), "TN": (-10.0, 35.0), "TAVG": (-5.0, 40.0), "RH_AVG": (0.0, 100.0),
    "RR": (0.0, 500.0), "FF_X": (0.0, 50.0), "FF_AVG": (0.0, 30.0), "SS": (0.0, 14.0),
}

# Physical limits of the mooring variables.
PHYSICAL_LIMITS = {"SST": (20.0, 35.0), "RAD": (0.0, 500.0)}

# Month lists behind each season scheme.
SEASONS = {
    "two_sep": {"Wet": (9, 10, 11, 12, 1, 2, 3), "Dry": (4, 5, 6, 7, 8)},
    "two_oct": {"Wet": (10, 11, 12, 1, 2, 3, 4), "Dry": (5, 6, 7, 8, 9)},
    "quarters": {"DJF": (12, 1, 2), "MAM": (3, 4, 5), "JJA": (6, 7, 8), "SON": (9, 10, 11)},
    "binned": {"Wet": (1, 2, 3), "Transition1": (4, 5, 6), "Dry": (7, 8, 9),
               "Transition2": (10, 11, 12)},
    "farm": {"Wet": (12, 1, 2, 3), "Dry": (7, 8, 9), "Transition": (4, 5, 6, 10, 11)},
}

# The sixteen compass names, clockwise from north.
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE",
           "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")

# Wind speed bin edges of the rose, m/s.
ROSE_EDGES = (0.0, 2.2, 4.2, 6.3, 8.3, 10.4, 15.0)

# Latitude per station site.
LATITUDES = {"Aceh": 5.5}

# Class limits and labels (below, inside, above) per variable.
CLASSES = {
    "rr": (2.0, 15.0, "Kering (Risiko)", "Optimal", "Banjir (Risiko)"),
    "tavg": (20.0, 35.0, "Dingin (Risiko)", "Optimal", "Panas (Risiko)"),
    "rh": (60.0, 90.0, "Kering (Risiko)", "Optimal", "Lembab Ekstrem (Risiko)"),
}
NO_DATA = "Tidak Ada Data"
NO_DATA_RISK = "Tidak Ada Data (Risiko)"
RAIN_UNAVAILABLE = "Data Hujan Tidak Tersedia"
WEIGHTS = {"rr": 40, "tavg": 40, "rh": 20}

# Decision labels.
INCOMPLETE = "Bera (Data Tidak Lengkap)"
FLOOD = "Bera (Risiko Banjir)"
HOT = "Bera (Risiko Suhu Tinggi)"
UNKNOWN_RAIN_CAUTION = "Tanam Dengan Caution (Data Hujan Tidak Lengkap)"
UNKNOWN_RAIN_DRY = {
    "monthly": "Bera (Data Hujan Tidak Tersedia di Musim Kering)",
    "seasonal": "Bera (Data Hujan Tidak Tersedia)",
}

# Upper limit, lower limit and the three labels per season class.
DECISION_BANDS = {
    "monthly": {
        "Wet": (75, 60, "Tanam (Kondisi Optimal)", "Tanam Dengan Caution",
                "Bera (Kondisi Tidak Optimal)"),
        "Dry": (85, 70, "Tanam (Kondisi Kering Optimal)", "Tanam Terbatas",
                "Bera (Musim Kering Risiko Tinggi)"),
        "Transition": (80, 65, "Tanam (Periode Transisi Optimal)", "Tanam Dengan Caution",
                       "Bera (Periode Transisi Risiko)"),
    },
    "seasonal": {
        "Wet": (75, 60, "Tanam (Musim Hujan Optimal)", "Tanam Dengan Caution (Musim Hujan)",
                "Bera (Kondisi Tidak Optimal)"),
        "Dry": (85, 70, "Tanam (Musim Kering Optimal)", "Tanam Terbatas (Musim Kering)",
                "Bera (Musim Kering Risiko Tinggi)"),
        "Transition": (80, 65, "Tanam (Periode Transisi Optimal)",
                       "Tanam Dengan Caution (Periode Transisi)",
                       "Bera (Periode Transisi Risiko)"),
    },
}

# Growth days by season class of the planting month.
GROWTH_DAYS = {"Wet": 105, "Dry": 95, "Transition": 100}

# Harvest labels.
HARVEST_EARLY_WET = "Percepat Panen 3-5 Hari (Risiko Hujan Tinggi)"
HARVEST_EARLY = "Percepat Panen 1-2 Hari (Risiko Hujan)"
HARVEST_ON_TIME_DRY = "Panen Sesuai Jadwal (Kondisi Kering Optimal)"
HARVEST_ON_TIME = "Panen Sesuai Jadwal"
WINDOW_LABELS = {
    "rain": ("Percepat Panen (Risiko Hujan)", "Pantau Cuaca"),
    "humid": ("Pertimbangkan Panen (Kelembaban Tinggi)", "Pantau Kelembaban"),
    "calm": ("Panen Sesuai Jadwal", "Belum Waktunya Panen"),
}

# Monthly suitability (minimum, maximum, weight).
SUITABILITY = {"SST": (27.0, 30.0, 0.3), "SWRad": (150.0, None, 0.4), "WSPD": (1.0, 6.0, 0.3)}
CALENDAR_LABELS = {"plant": "Tanam", "harvest": "Panen", "fallow": "Bera",
                   "unfit": "Tidak Sesuai"}

# Decision label to code.
DECISION_CODES = {"Tanam": 3, "Tanam (Waspada)": 2, "Bera": 1, "Bera (Risiko Tinggi)": 0,
                  "Percepat Panen (Risiko Hujan)": 4}

# Candidate season lengths per variable.
SEASON_LENGTHS = {"RR": (365, 183, 90), "TAVG": (365, 30, 15), "RH_AVG": (30, 14, 7)}
DEFAULT_SEASON_LENGTH = {"TAVG": 30, "RH_AVG": 30}
