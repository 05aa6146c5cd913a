"""Fixed values of the nowcast."""

# Distances in km.
PIN_KM, OVER_KM, LOCAL_KM, TRACK_KM = 5.0, 8.0, 25.0, 100.0
LINK_KM, CORE_RADIUS_KM = 6.5, 18.0
IDW_CUTOFF_KM, GRID_HALF_KM = 80.0, 60.0
STRIKE_KM, CITY_KM = 20.0, 30.0
# Gates in km for 30 minutes.
TRAIL_TRUST_KM, TRAIL_SOLO_KM, MATCH_KM = 10.0, 14.0, 45.0
GATE_SECONDS = 1800
# Speeds in km/h, times in minutes.
MAX_SPEED, MIN_SPEED, APPROACH_SPEED = 95.0, 4.0, 8.0
HORIZON_MIN, TIMELINE_STEP, ARROW_MIN = 90, 5, 30
LEADS = (10, 20, 30, 40, 50, 60)
CORE_LEVEL, MIN_MASS = 3, 12
CONFIDENCE_MIN, REGIONAL_MIN = 72, 60
# Motion grid.
NCC_CELL_KM, FIELD_CELLS, NCC_MIN, AGREE_DEG = 3.0, 40, 0.4, 40.0
MAX_SHIFT_KM, MAX_SHIFT_CELLS = 70.0, 24
# Rain grid.
LAT_MIN, LAT_MAX, LON_MIN, LON_MAX = 48.8, 55.15, 13.8, 24.6
CELL_LAT, CELL_LON, MAX_CELLS = 0.027, 0.044, 9000
EARTH_KM, EARTH_M = 6371.0, 6370997.0
ORIGIN_LAT, ORIGIN_LON = 52.1, 19.35
AEQD_LAT, AEQD_LON = 52.3469, 19.0926
RASTER = 800
UL_LON, UL_LAT, LR_LON, LR_LAT = 11.6, 56.3, 25.3, 48.0
# Rain rate in mm/h at which classes 1 to 4 begin.
CLASS_RATES = (0.1, 1.0, 4.0, 10.0)
HAIL_DBZ = 55

# Radar palette, dBZ and its colour.
PALETTE = (
    (15, 0x88DDEE), (16, 0x6CD1EB), (17, 0x51C5E8), (18, 0x36BAE5), (19, 0x1BAEE2), (20, 0x00A3E0), (21, 0x009AD5), (22, 0x0091CA), (23, 0x0088BF),
    (24, 0x007FB4), (25, 0x0077AA), (26, 0x0070A3), (27, 0x00699C), (28, 0x006295), (29, 0x005B8E), (30, 0x005588), (31, 0x005180), (32, 0x004E78),
    (33, 0x004A70), (34, 0x004768), (35, 0xFFEE00), (36, 0xFFE000), (37, 0xFFD200), (38, 0xFFC500), (39, 0xFFB700), (40, 0xFFAA00), (41, 0xFF9F00),
    (42, 0xFF9500), (43, 0xFF8B00), (44, 0xFF8100), (45, 0xFF4400), (46, 0xF23600), (47, 0xE62800), (48, 0xD91B00), (49, 0xCD0D00), (50, 0xC10000),
    (51, 0xA80000), (52, 0x8F0000), (53, 0x760000), (54, 0x5D0000), (55, 0xFFAAFF), (56, 0xFF9FFF), (57, 0xFF95FF), (58, 0xFF8BFF), (59, 0xFF81FF),
    (60, 0xFF77FF), (61, 0xFF6CFF), (62, 0xFF62FF), (63, 0xFF58FF), (64, 0xFF4EFF), (65, 0xFFFFFF), (75, 0x00FF00),
)
NEAREST_COLOUR = 28

# Calibrated chance in percent by rung.
CHANCES = (
    ("echoFar", 10), ("legacyArea20", 10), ("legacyArea30", 15), ("legacyArea40", 15), ("willHitEta20to45", 50), ("legacyCloseEcho", 20),
    ("willHitApproachingKlasa2", 55), ("overPinKlasa2", 90), ("willHitEtaLe20", 90), ("overPinNowKlasa2", 90), ("overPinKlasa3", 95),
    ("receding", 10), ("missBeside", 10), ("imgwWatch", 15),
)

# Compass of eight, "from" and "toward".
FROM_PL = ("północy", "północnego wschodu", "wschodu", "południowego wschodu", "południa", "południowego zachodu", "zachodu", "północnego zachodu")
TOWARD_PL = ("północ", "północny wschód", "wschód", "południowy wschód", "południe", "południowy zachód", "zachód", "północny zachód")

# Cities with their county code.
CITIES = (
    (52.2297, 21.0122, "Warszawa", "Warszawą", "1465"), (50.0647, 19.945, "Kraków", "Krakowem", "1261"), (51.1079, 17.0385, "Wrocław", "Wrocławiem", "0264"),
    (51.1492, 15.0084, "Zgorzelec", "Zgorzelcem", "0225"), (52.4064, 16.9252, "Poznań", "Poznaniem", "3064"), (54.352, 18.6466, "Gdańsk", "Gdańskiem", "2261"),
    (51.7592, 19.456, "Łódź", "Łodzią", "1061"), (50.2649, 19.0238, "Katowice", "Katowicami", "2469"), (51.2465, 22.5684, "Lublin", "Lublinem", "0664"),
    (53.4285, 14.5528, "Szczecin", "Szczecinem", "3262"), (53.1325, 23.1688, "Białystok", "Białymstokiem", "2061"), (50.0412, 21.9991, "Rzeszów", "Rzeszowem", "1861"),
    (53.1235, 18.0084, "Bydgoszcz", "Bydgoszczą", "0461"), (50.8661, 20.6286, "Kielce", "Kielcami", "2661"), (53.7784, 20.4801, "Olsztyn", "Olsztynem", "2862"),
    (50.6751, 17.9213, "Opole", "Opolem", "1661"), (54.5189, 18.5305, "Gdynia", "Gdynią", "2262"), (50.811, 19.1203, "Częstochowa", "Częstochową", "2461"),
    (50.3249, 18.6714, "Gliwice", "Gliwicami", "2465"), (54.4641, 17.0282, "Słupsk", "Słupskiem", "2263"), (52.1639, 21.0726, "Otwock", "Otwockiem", "1417"),
)
NICE_METRES = (50, 100, 200, 500, 1_000, 2_000, 5_000, 10_000, 20_000, 50_000, 100_000)
