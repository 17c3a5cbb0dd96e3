"""Instruments by table: ranges, velocity conventions, fixed settings; a run's parameters with their provenance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrv.functions.spectral import uniform_bins

@dataclass(frozen=True)
class Instrument:
    """wave range of the orders and of the compiled lines (nm), reference wavelength, resolution, unit of the header's
    barycentric velocity (km/s, m/s, or none where spectra are already in the barycentre), number of uniform bins."""

    name: str
    source: str
    wave: tuple[float, float]
    window: tuple[float, float]
    reference: float
    resolution: float
    berv: str
    bins: int = 15
    in_air: bool = False


#: Fixed values of the instruments and reductions.
INSTRUMENTS = (
    Instrument("SPIROU", "APERO", (955.793, 2515.771), (900, 2500), 1600, 70_000, "km/s", 25),
    Instrument("SPIROU", "CADC", (955.793, 2515.771), (900, 2500), 1600, 70_000, "km/s", 25),
    Instrument("NIRPS_HA", "APERO", (965.7, 1949.1), (900, 1950), 1600, 80_000, "km/s", 25),
    Instrument("NIRPS_HE", "APERO", (965.8, 1951.5), (900, 1950), 1600, 80_000, "km/s", 25),
    Instrument("NIRPS_HA", "CADC", (965.7, 1949.1), (900, 1950), 1600, 80_000, "km/s", 25),
    Instrument("NIRPS_HE", "CADC", (965.8, 1951.5), (900, 1950), 1600, 80_000, "km/s", 25),
    Instrument("NIRPS_HA", "ESO", (966.051, 1923.084), (900, 1825), 1600, 80_000, "none", 25),
    Instrument("NIRPS_HE", "ESO", (966.051, 1923.084), (900, 1825), 1600, 80_000, "none", 25),
    Instrument("HARPS", "ORIG", (378.06, 691.476), (400, 700), 550, 115_000, "km/s", in_air=True),
    Instrument("HARPS", "ESO", (378.06, 691.476), (400, 700), 550, 115_000, "none"),
    Instrument("HARPSN", "ORIG", (378.06, 691.476), (400, 700), 550, 115_000, "km/s", in_air=True),
    Instrument("HARPSN", "ESO", (378.06, 691.476), (400, 700), 550, 115_000, "none"),
    Instrument("ESPRESSO", "None", (377.189, 790.788), (450, 750), 650, 140_000, "none"),
    Instrument("CARMENES", "None", (513.651, 970.0), (500, 1000), 750, 94_000, "km/s"),
    Instrument("MAROONX", "BLUE", (490.53, 668.29), (491, 668), 500, 85_000, "m/s"),
    Instrument("MAROONX", "RED", (646.88, 907.53), (647, 907), 800, 85_000, "m/s"),
    Instrument("SOPHIE", "None", (387.2, 694.3), (387.2, 694.3), 550, 75_000, "km/s", in_air=True),
    Instrument("CORALIE", "None", (386.8, 689.8), (386.8, 689.8), 550, 60_000, "km/s", in_air=True),
    Instrument("EXPRES", "None", (379.66, 822.36), (379.66, 822.36), 550, 150_000, "km/s"),
)

#: Photometric bands (nm; the red end of j is as the original has it, so that no instrument holds that band),
#: bands that some instruments name themselves, and regions of the detector (name, pixels), near infrared, optical and one red arm.
PHOTOMETRIC = {
    "u": (305.511, 403.064), "g": (379.764, 555.304), "r": (541.823, 699.442), "i": (669.241, 840.032), "z": (796.470, 1087.333), "y": (938.600, 1113.400),
    "j": (1148.178, 13494.41), "h": (1450.980, 1809.105), "k": (1985.930, 2401.514),
}
OWN_BANDS = {
    ("SPIROU", None): {"Y": (900.0, 1113.4), "gapYJ": (1113.4, 1153.586), "J": (1153.586, 1354.422), "gapJH": (1354.422, 1462.897), "H": (1462.897, 1808.544), "gapHK": (1808.544, 1957.792), "K": (1957.792, 2343.105), "redK": (2343.105, 2500.0)},
    ("MAROONX", "BLUE"): {"u": (360.804, 402.823), "g": (467.178, 554.926), "r": (614.112, 698.914)},
}
INFRARED_REGIONS = {"": (0, 4088), "_0-2044": (0, 2044), "_2044-4088": (2044, 4088), "_1532-2556": (1532, 2556)}
OPTICAL_REGIONS = {"": (0, 4096), "_0-2044": (0, 2048), "_2044-4088": (2048, 4096)}
RED_ARM_REGIONS = {"": (0, 4036), "_0-2018": (0, 2018), "_2018-4036": (2018, 4096)}


def bands_of(instrument: Instrument) -> dict[str, tuple[float, float]]:
    """An instrument's bands: its own, or the photometric ones that lie strictly within its orders, and its uniform bins."""
    own = OWN_BANDS.get((instrument.name, None)) or OWN_BANDS.get((instrument.name, instrument.source))
    named = own or {k: (a, b) for k, (a, b) in PHOTOMETRIC.items() if a > instrument.wave[0] and b < instrument.wave[1]}
    return named | {k: (a, b) for k, a, b in uniform_bins(*map(float, instrument.window), instrument.bins)}


def regions_of(instrument: Instrument) -> dict[str, tuple[int, int]]:
    """The regions of its detector; bands hold what lies strictly inside of one."""
    if instrument.name.startswith(("SPIROU", "NIRPS")):
        return INFRARED_REGIONS
    return RED_ARM_REGIONS if (instrument.name, instrument.source) == ("MAROONX", "RED") else OPTICAL_REGIONS


def band_rows() -> list[tuple[str, str, str, float, float, float, float]]:
    """instrument, source, band with its region's name, low, high, first, last of all instruments: some thousand rows at most."""
    return [(i.name, i.source, b + r, *ends, float(first), float(last)) for i in INSTRUMENTS for b, ends in bands_of(i).items() for r, (first, last) in regions_of(i).items()]


#: Fixed values of a run, unless it says otherwise.
DEFAULTS = {
    "N_ITERATIONS": (20, "rounds of an exposure's velocity"), "MAX_N_GOOD_ITERS": (15, "rounds from which an exposure counts as bad"), "LINE_MIN_PIX_WIDTH": (5, "least pixels of a line"),
    "BULK_ERROR_CONVERGENCE": (1.0, "errors within which a velocity has settled"), "RMS_SIGCLIP_THRES": (5, "sigmas beyond which a pixel goes"), "NOISE_SAMPLING_WIDTH": (2e5, "width of noise boxes, m/s"),
    "CCF_SNR_MIN": (7, "least signal of a cross-correlation"), "FRAC_TIME_MEAS": (0.1, "least share of exposures that measure a line"), "MEDBINMAX": (19, "most bins of a template"),
    "MAX_CONVERGENCE_RV": (100, "scatter at which a template has settled, m/s"), "WEIGHT_MIN": (0.1, "least weight of a template's pixel"), "SNR_THRES": (10, "least signal of a template's pixel"),
    "LINE_NSIG_THRES": (8, "sigmas beyond which a line goes"), "CCF_HP_SCALE": (30, "high-pass of a correlation, km/s"), "USE_NOISE_MODEL": (False, "whether noise is taken from boxes"),
    "ROUGH_CCF_MIN_RV": (-3e5, "first velocity of a rough correlation, m/s"), "ROUGH_CCF_MAX_RV": (3e5, "last velocity of a rough correlation, m/s"), "ROUGH_CCF_STEP": (500, "its step, m/s"), "ROUGH_CCF_EWIDTH_GUESS": (2000, "its first guess of a width, m/s"),
    "MASK_CCF_REACH": (200, "velocities of a list's correlation on both sides, km/s"), "MASK_CCF_STEP": (0.5, "its step, km/s"), "CUT_PEARSONR": (-1, "chance below which a correlated line goes; none if negative"), "NUM_UNIFORM_WAVEBIN": (15, "uniform bins of the compiled table"),
    "ADD_UNIFORM_WAVEBIN": (False, "whether there are uniform bins"), "FORCE_SIGMA_PER_LINE": (False, "whether errors are scaled to each line's spread"), "MAX_PIXEL_WIDTH": (50, "pixels from which a line is too wide to compile"), "BIAS_NSIG": (100, "sigmas beyond which a bias goes"),
    "TEMPLATE_ROUNDS": (5, "most rounds of a template"), "BLAZE_SMOOTH_SIZE": (20, "pixels over which an order's edges fade"), "BLAZE_THRESHOLD": (0.2, "least blaze of an order's pixel"), "DO_TELLUCLEAN": (False, "whether the air is taken off"),
    "TELLU_ROUNDS": (20, "most rounds of the air's exponents"), "TELLU_KERNEL_WIDTH": (1.4, "width of the air's kernel, pixels"), "TELLU_KERNEL_SHAPE": (2.2, "its power"), "TELLU_SIGMA_CUT": (10, "sigmas beyond which a pixel of the air goes"),
    "TELLU_WATER_BOUNDS": ((0.01, 15.0), "least and greatest exponent of water"), "TELLU_OTHERS_BOUNDS": ((0.05, 15.0), "least and greatest exponent of all else"), "TELLU_FORCE_AIRMASS": (False, "whether the exponent of all else is the airmass"),
    "DATA_TYPE": ("SCIENCE", "kind of the exposures"), "MJD_START": (None, "first date of a template's exposures"), "MJD_END": (None, "last date of a template's exposures"),
}


def parsed(text: str) -> object:
    """A value as a file or command line has it: a literal (number, truth, None, list), else the text without quotes."""
    import ast

    text = text.strip()
    words = {"true": True, "false": False, "none": None, "null": None, "": None}
    if text.lower() in words:
        return words[text.lower()]
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def parameters_from_file(text: str) -> dict[str, object]:
    """Parameters of a file's text: lines KEY: value, and lists as lines - value below KEY:; what follows a # is a comment."""
    out: dict[str, object] = {}
    key = None
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip() if not line.lstrip().startswith("#") else ""
        if not line or line == "---":
            continue
        if line.lstrip().startswith("- "):
            if key is None:
                raise ValueError(f"a list without a key: {line!r}")
            held = out[key] if isinstance(out[key], list) else []
            out[key] = [*held, parsed(line.lstrip()[2:])]
            continue
        name, colon, value = line.partition(":")
        if not colon or not name.strip() or line[0].isspace():
            raise ValueError(f"neither a key nor an item of a list: {line!r}")
        key = name.strip().strip("'\"")
        out[key] = parsed(value)
    return out


def parameters_from_arguments(arguments: Sequence[str]) -> dict[str, object]:
    """Parameters of a command line: --key=value, --key value, and --key alone for True; names in capitals."""
    out: dict[str, object] = {}
    rest = list(arguments)
    while rest:
        word = rest.pop(0)
        if not word.startswith("--"):
            raise ValueError(f"no parameter: {word!r}")
        name, equals, value = word[2:].partition("=")
        if not equals and rest and not rest[0].startswith("--"):
            equals, value = "=", rest.pop(0)
        out[name.replace("-", "_").upper()] = parsed(value) if equals else True
    return out


def parameters(*layers: tuple[str, Mapping[str, object]]) -> dict[str, tuple[object, str, str]]:
    """Value, source and description of each parameter; later layers (file, call, command line) win over earlier ones."""
    out = {k: (v, "default", text) for k, (v, text) in DEFAULTS.items()}
    for source, values in layers:
        for k, v in values.items():
            out[k] = (v, source, out[k][2] if k in out else "")
    return out


def parameter_table(spark: SparkSession, found: Mapping[str, tuple[object, str, str]]) -> DataFrame:
    rows = [(k, str(v), text, source, type(v).__name__) for k, (v, source, text) in found.items()]
    return spark.createDataFrame(rows, "NAME string, VALUE string, DESCRIPTION string, SOURCE string, DATATYPE string")


def table(spark: SparkSession) -> DataFrame:
    rows = [(i.name, i.source, *map(float, (*i.wave, *i.window, i.reference, i.resolution)), i.berv, i.bins) for i in INSTRUMENTS]
    return spark.createDataFrame(rows, "instrument string, source string, wave_low double, wave_high double, low double, high double, reference double, resolution double, berv_unit string, bins int")


def barycentric_velocity(berv: Column, unit: Column, calibration: Column) -> Column:
    """m/s; calibrations and spectra in the barycentre have none."""
    return F.when(calibration | (unit == "none"), 0.0).when(unit == "km/s", berv * 1000).otherwise(berv)


#: Kinds of exposures, and those of EXPRES that have no barycentric velocity.
KINDS = ("SCIENCE", "FP", "LFC")
STILL = ("FP", "LFC", "SUN")


def velocity_of(instrument: Column, berv: Column, unit: Column, kind: Column) -> Column:
    """Barycentric velocity in m/s by an instrument's rules: EXPRES has none for calibrations, the sun, or without a key."""
    express = (instrument == "EXPRES") & (kind.isin(*STILL) | berv.isNull())
    return F.when(express, 0.0).otherwise(barycentric_velocity(berv, unit, kind.isin("FP", "LFC")))


def reduced_date(instrument: Column, bjd: Column, mjd: Column, mid_exposure: Column) -> Column:
    """Reduced Julian date: CARMENES writes it as such, MAROON-X has one date for all, others fall back on the mid exposure."""
    usual = F.coalesce(bjd - 2400000.0, mid_exposure + 0.5)
    return F.when(instrument == "CARMENES", bjd).when(instrument == "MAROONX", mjd + 0.5).otherwise(usual)


def reject_reason(kind: Column, order_snr: Column, ccf_snr: Column, least_order: float = 1.0, least_ccf: float = 7.0) -> Column:
    """Why an exposure is left out: unknown kind, too little light in an order, too weak a correlation; null if it is kept."""
    unknown = ~F.coalesce(kind.isin(*KINDS), F.lit(False))
    return F.when(unknown, "kind").when(F.coalesce(order_snr < least_order, F.lit(True)), "order").when(F.coalesce(ccf_snr < least_ccf, F.lit(True)), "correlation")
