"""Published code lists and analysis selections."""

# Diagnosis codes of chronic kidney disease, stage 4 or 5 (both code systems).
CKD_CODES = [
    "5856", "40391", "N186", "I120", "5854", "N184", "I132", "5855", "N185", "40311", "40301", "40493",
    "I1311", "40492", "40403", "40413",
]

# Diagnosis codes of type 2 diabetes (both code systems).
T2D_CODES = [
    "25000", "E119", "E1122", "25060", "E1165", "25040", "E1140", "25050", "E1151", "25002", "25080",
    "E11319", "E1142", "E1121", "E11649", "25062", "E11621", "25042", "25082", "E1169", "E1143", "25052",
    "25070", "E1152", "E118", "25012", "25092", "E11610", "25072", "E11622", "E1110", "25090", "E11628",
    "E1139", "E1136", "E1100", "25022", "E113599", "E113299", "O2412", "E11311", "25020", "E113593",
    "E1159", "E11329", "E1149", "E113293", "E11359", "E1129", "E113499", "E113399", "E1141", "O24113",
    "E113592", "E113591", "E113513", "O24111", "E113393", "E1144", "25032", "E113291", "E113519",
    "E113292", "E113219", "E11349", "O24112", "E11641", "E113313", "25010", "25030", "E1101", "E11620",
    "E113493", "E11351", "E11339", "E113213", "E113319", "E113413", "E11321", "E113492", "O2413",
    "E1137X9", "E113391", "E11331", "E113311", "E11341", "E113491", "E113542", "E113511", "E11618",
    "E113532", "E113392", "E113512", "E113521", "E113212", "E113419", "E113553", "E113211",
]

DISEASES = {"ckd": CKD_CODES, "t2d": T2D_CODES}

# The 26 most frequent analyses.
COMMON_ANALYSES = [
    51221, 50912, 51265, 51006, 51222, 51301, 51249, 51279, 51250, 51248, 51277, 50971, 50983, 50902,
    50882, 50868, 50931, 50893, 50960, 50970, 50934, 51678, 50947, 51237, 51274, 50920,
]

# Analyses per category, at most 20 each.
ANALYSIS_CATEGORIES = {
    "body_fluids": [52065, 51127, 50849],
    "cardiology": [51003, 50911, 50963, 50908],
    "endocrine": [50993, 50995, 50965, 50946, 50994, 50973, 50896],
    "hematology": [
        51221, 51265, 51222, 51301, 51249, 51279, 51250, 51248, 51277, 51237, 51274, 52172, 51275, 51244,
        51256, 51254, 51146, 51200, 51498, 51486,
    ],
    "hepatic_renal": [51059],
    "hepatology": [50861, 50878, 50885, 50863, 51464, 51514, 50883, 50884, 50927],
    "immunology_inflammation": [51288, 50873, 50980, 50874],
    "infectiology": [
        51506, 51508, 51487, 51087, 51463, 51519, 51476, 51512, 50889, 51009, 50856, 50941, 50943, 53153,
        51287, 50940, 50942, 51865, 51873, 50937,
    ],
    "metabolic": [
        50882, 50868, 50931, 50893, 50960, 50970, 51491, 51478, 51484, 52033, 50820, 50821, 50802, 50804,
        50818, 50813, 50954, 50907, 51000, 50904,
    ],
    "muscular": [50910],
    "nutrition": [50862, 51492, 50956, 50867, 50853, 50925],
    "pulmonary": [52391, 51054, 51457],
    "renal": [
        50912, 51006, 50971, 50983, 50902, 50920, 50808, 50822, 51082, 51007, 51102, 51100, 51069, 51070,
        51093, 51097, 51078, 51104, 51469, 51067,
    ],
    "reproduction": [51085, 50988, 50926],
    "toxicology": [
        50922, 50981, 50999, 51092, 51079, 51075, 51071, 51090, 51074, 50880, 50879, 51989, 51008, 51089,
        50957,
    ],
    "tumor_marker": [50974, 50900, 50864, 50898],
}

# Prediction windows of the extraction grid, symbol -> days.
PREDICTION_WINDOWS = {"3m": 90, "1y": 365, "2y": 730, "5y": 1825}

# The category whose dates become the label dates.
LABEL_CATEGORY = "hematology"
