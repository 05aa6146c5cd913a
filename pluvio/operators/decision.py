"""From what is near a pin to a chance, a level and words; ordered rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pluvio.functions.const import CHANCES, CITIES, OVER_KM, PIN_KM, TRACK_KM
from pluvio.functions.geo import half_up


def chance_ladder() -> tuple[Column, Column]:
    """The winning rung and its raw percent.

    Of the raises that apply, the highest wins, the earliest of equals; then two caps lower it.
    Columns: will_hit, approaching, receding, expect_level, pin_level, nearest_km, eta, miss_km, degree.
    """
    hit, level, near, eta = F.col("will_hit"), F.col("pin_level"), F.col("nearest_km"), F.col("eta")
    raises = (
        (F.lit(True), F.lit(10), "echoFar"), (F.col("degree").isNotNull(), 15 + F.greatest(F.col("degree"), F.lit(1)) * 10, "imgwWatch"),
        (hit & F.col("approaching") & (F.col("expect_level") >= 2), F.lit(60), "willHitApproachingKlasa2"), ((near <= OVER_KM) & (level >= 2), F.lit(70), "overPinKlasa2"),
        ((eta == 0) & (level >= 2), F.lit(80), "overPinNowKlasa2"), ((eta > 0) & (eta <= 20) & hit, F.lit(70), "willHitEtaLe20"),
        ((eta > 20) & (eta <= 45) & hit, F.lit(50), "willHitEta20to45"), ((near <= PIN_KM) & (level >= 3), F.lit(90), "overPinKlasa3"),
    )
    rungs = [F.when(F.coalesce(holds, F.lit(False)), F.struct(raw.cast("int").alias("raw"), F.lit(-i).alias("order"), F.lit(name).alias("rung"))) for i, (holds, raw, name) in enumerate(raises)]
    top = F.array_max(F.array_compact(F.array(*rungs)))
    gone = F.col("receding") & (near.isNull() | (near > OVER_KM)) & (top["raw"] > 20)
    raw, rung = F.when(gone, 20).otherwise(top["raw"]), F.when(gone, F.lit("receding")).otherwise(top["rung"])
    low = F.greatest(F.lit(15), raw - 20)
    beside = F.coalesce((F.col("miss_km") > PIN_KM + 8) & ~hit & (low < raw), F.lit(False))
    return F.when(beside, F.lit("missBeside")).otherwise(rung), F.when(beside, low).otherwise(raw)


def rounded_chance(raw: Column) -> Column:
    """To fives, from 5 to 95."""
    return F.greatest(F.lit(5), F.least(F.lit(95), (half_up(raw / 5.0) * 5).cast("int")))


def calibrated(rung: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for row in CHANCES for x in row])[rung], F.lit(10))


def chance() -> Column:
    """The calibrated chance where there is echo within 100 km, the raw one elsewhere."""
    rung, raw = chance_ladder()
    return F.when(F.coalesce(F.col("nearest_km") <= TRACK_KM, F.lit(False)), calibrated(rung)).otherwise(rounded_chance(raw))


def expect_level(cell: Column, timeline: Column) -> Column:
    """The class to expect: over the pin that of its neighbourhood, else what comes."""
    over = F.coalesce(F.col("nearest_km") <= OVER_KM, F.lit(False))
    coming = F.greatest(F.when(F.col("will_hit") | F.col("approaching"), cell).otherwise(0), F.when(F.col("will_hit"), timeline).otherwise(0))
    return F.greatest(F.col("pin_level"), F.when(over, 0).otherwise(coming))


def threat_level(active: Column, upcoming: Column) -> Column:
    """The last rule that holds."""
    hit = F.col("will_hit") & (F.col("expect_level") >= 2)
    rules = F.when((F.col("nearest_km") <= OVER_KM) & (F.col("pin_level") >= 2), "now").when((F.col("eta") > 0) & (F.col("eta") <= 25) & hit, "imminent")
    return rules.when(hit, "nearby").when(active | upcoming, "watch").otherwise("clear")


# The words below are the answers themselves.


def expect_words(level: Column, hail: Column) -> Column:
    heavy = F.when(hail, "silnej ulewy, porywów wiatru, możliwego gradu").otherwise("silnej ulewy, porywów wiatru")
    return F.when(level >= 4, heavy).when(level >= 3, "ulewy i porywistego wiatru").when(level >= 2, "deszczu i mokrej jezdni").when(level >= 1, "słabego deszczu")


def storm_noun(level: Column, lightning: Column) -> Column:
    return F.when(lightning & (level >= 3), "Burza").when(level >= 3, "Ulewa").otherwise("Deszcz")


def title(level: Column, lightning: Column) -> Column:
    """The headline of a threat level."""
    coming = F.when(F.col("receding"), "Opad oddala się").when(F.col("approaching") & ~F.coalesce(F.col("eta") == 0, F.lit(False)), "Opad nadciąga").otherwise("Opad w okolicy")
    now = F.concat(storm_noun(F.greatest(F.col("pin_level"), F.lit(2)), lightning), F.lit(" nad Tobą"))
    soon = F.concat(storm_noun(F.col("expect_level"), lightning), F.lit(" nadciąga"))
    return F.when(level == "now", now).when(level == "imminent", soon).when(level == "nearby", coming).when(level == "watch", "Ostrzeżenie IMGW").otherwise("Czysto")


FORM_NOTE = "Komórka może też urosnąć na miejscu — tego radar nie zapowie."
ISSUED = "Instytut wydał ostrzeżenie dla powiatu."


def over_phrase(label: Column) -> Column:
    """A place as what rain hangs over: a known city by its name, any other as the pin."""
    names = F.create_map(*[F.lit(x) for _, _, city, over, _ in CITIES for x in (city, f"nad {over}")])
    return F.coalesce(names[label], F.lit("nad Twoją pinezką"))


def about_pin() -> Column:
    """Whether what comes is about the pin at all: echo within 80 km, a hit, or something that comes by within 20 km."""
    return F.coalesce(F.col("nearest_km") <= 80, F.lit(False)) | F.col("will_hit") | (F.col("approaching") & F.coalesce(F.col("miss_km") <= 20, F.lit(False)))


def detail() -> Column:
    """The text under the headline; the first case that holds.

    Columns: label, level, eta, pin_level (the strongest echo over the pin), nearest_km, receding,
    approaching, will_hit, miss_km, speed_kmh, coming_from, toward, chance, body.
    """
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    whole = lambda x: half_up(x).cast("long").cast("string")
    who, over, eta, near, miss = F.col("label"), over_phrase(F.col("label")), F.col("eta"), F.col("nearest_km"), F.col("miss_km")
    came, chance_ = F.col("coming_from"), F.col("chance").cast("string")
    dist = F.when(near.isNotNull(), say("ok. ", whole(near), " km od ", who)).otherwise(say("w okolicy ", who))
    later = eta > 0
    cases = (
        ((eta == 0) & ((F.col("pin_level") >= 1) | (near <= PIN_KM)), say("Opad jest ", over, " teraz. ", FORM_NOTE)),
        (F.col("receding") & about_pin(), say(F.coalesce(say("Idzie od ", came), F.lit("Komórka")), " (", dist, ") i odchodzi na ", F.coalesce(F.col("toward"), F.lit("bok")), ". Szansa ~", chance_, "%. ", FORM_NOTE)),
        (F.col("will_hit") & came.isNotNull(), say("Idzie od ", came, F.when(F.col("speed_kmh") > 0, say(" (~", whole(F.col("speed_kmh")), " km/h)")).otherwise(""), ", echo ", dist, ".", F.when(later, say(" Dojście ", over, ": ok. ", eta.cast("string"), " min.")).otherwise(""), " Szansa ~", chance_, "%. To ruch echa, nie pewność. ", FORM_NOTE)),
        (came.isNotNull() & (miss > PIN_KM) & (near.isNull() | (near > OVER_KM)), say("Idzie od ", came, ", echo ", dist, ". Tor minie ", who, " ok. ", whole(miss), " km obok", F.when(later, say(" za ~", eta.cast("string"), " min")).otherwise(""), ". Nad samym punktem szansa ~", chance_, "%. ", FORM_NOTE)),
        (near.isNotNull(), say("Echo ", dist, F.coalesce(say(", od ", came), F.lit("")), ". Szansa ~", chance_, "%. ", FORM_NOTE)),
        (F.col("level") == "watch", say(F.coalesce(F.col("body"), F.lit(ISSUED)), " Dla ", who, " szansa z radaru ~", chance_, "% na ~45 min.")),
        (F.col("level") == "clear", say(F.upper(F.substring(over, 1, 1)), F.substring(over, 2, 1000), f" radar nie widzi groźnej komórki w promieniu {TRACK_KM:.0f} km. Szansa ~", chance_, "% na ok. 45 min. ", FORM_NOTE)),
    )
    out = say("Szansa ~", chance_, "% dla ", who, ". ", FORM_NOTE)
    for holds, text in reversed(cases):
        out = F.when(F.coalesce(holds, F.lit(False)), text).otherwise(out)
    return out
