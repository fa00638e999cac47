"""What file and track names say: tokens, sound categories, parts, kinds and instrument families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Instrument classes by family, and the words of names. The lists must equal those that labels were made with.
FAMILIES = {
    "guitar": ["acoustic_guitar", "clean_electric_guitar", "distorted_electric_guitar"],
    "bass": ["acoustic_bass", "electric_bass"],
    "keys": ["acoustic_piano", "electric_piano", "organ", "chromatic_percussion"],
    "synth": ["synth_lead", "synth_pad", "synth_strings"],
    "strings": ["violin", "viola", "cello", "contrabass", "orchestral_harp", "string_ensemble"],
    "brass": ["trumpet", "trombone", "tuba", "french_horn", "brass_section", "orchestra_hit"],
    "winds": ["soprano_and_alto_sax", "tenor_sax", "baritone_sax", "oboe", "english_horn", "bassoon", "clarinet", "flutes"],
    "vocals": ["voice"],
    "drums": ["drums", "timpani"],
}
GUITAR_WORDS = "gtr gtrs guitar guitars guit gt"
ACOUSTIC_WORDS = "ac acoustic acc acous nylon classical steelstring"
BASS_WORDS = "bass basses bassdi bassamp"
SFX_WORDS = "sfx fx riser risers rise rising sweep sweeps subdrop drop reverse reversed rev noise whoosh impact impacts uplifter downlifter swell ambience ambient atmos suck vinyl laugh wolf"
DRUM_WORDS = (
    "kick kik snare snr hat hats hihat hh tom toms overhead overheads oh ohs room rooms cymbal cymbals crash ride drum drums kit perc percussion tamb tambourine shaker shakers clap claps "
    "handclap handclaps cowbell conga congas bongo bongos woodblock maracas triangle djembe cajon timbale timbales trigger stick sticks snap snaps fingersnap tambo timp timpani drumkit break breaks anvil rde"
)
WEAK_DRUM_WORDS = "sample samples"
VOCAL_WORDS = "vox vocal vocals voc voice voices bv bvs bvox choir harmony harmonies adlib adlibs whisper singer sing chant chants"
STRING_WORDS = "string strings violin violins viola violas cello cellos fiddle orchestra pizz pizzicato"
WIND_WORDS = "trumpet trumpets trombone trombones horn horns brass tuba flugelhorn sax saxophone flute flutes clarinet oboe bassoon harmonica whistle recorder piccolo"
EPIANO_WORDS = "rhodes wurli wurlitzer epiano ep clav clavinet elecpiano rhodespiano"
PIANO_WORDS = "piano pianos pno grand keys key keyboard keyboards celesta celeste glock glockenspiel vibes vibraphone marimba xylophone"
ORGAN_WORDS, PAD_WORDS, LEAD_WORDS, LONE_LEAD_WORDS = "organ organs hammond leslie b3", "pad pads drone drones", "lead leads", "stylophone"
SYNTH_WORDS = "synth synths synthesizer moog arp arps seq sequence pluck plucks juno korg prophet mellotron theremin"
TONAL_WORDS = "loop loops mandolin banjo ukulele sitar accordion bells bell chimes"
EXCLUDED_WORDS = "click metronome guide unused mix master premaster mixdown"
MIC_WORDS = "mic mics amp amps di close far sm md ribbon dyn condenser front back top bottom vox orange marshall mesa fender cab direct"
#: Programs of a family, first to last.
PROGRAMS = {"guitar": (24, 31), "bass": (32, 39), "keys": (0, 23), "strings": (40, 55), "brass": (56, 63), "winds": (64, 79), "synth": (80, 103)}


def tokens(name: Column) -> Column:
    """Lower-case runs of letters (camel case parts them) and of figures of a file name without its ending."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"\.[^.]*$", "")
    return F.transform(F.regexp_extract_all(stem, F.lit("[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"), F.lit(0)), F.lower)


def held(value: Column, rule) -> Column:
    """rule(value), with the value computed once for all places that use it; as plain columns each place computes it anew."""
    return F.get(F.transform(F.array(value), rule), F.lit(0))


def any_of(found: Column, words: str) -> Column:
    return F.arrays_overlap(found, F.array(*[F.lit(w) for w in words.split()]))


def categorize(name: Column) -> Column:
    """The first of fifteen sound categories whose rule holds; 'other' if none does."""
    return held(tokens(name), category_of)


def category_of(t: Column) -> Column:
    """The sound category of a name's tokens."""
    return held(F.array_join(F.filter(t, lambda x: ~x.rlike("^[0-9]+$")), ""), lambda joined: first_category(t, joined))


def first_category(t: Column, joined: Column) -> Column:
    has = lambda words: any_of(t, words)
    guitar = has(GUITAR_WORDS) | joined.contains("guitar")
    return (
        F.when(guitar & has(ACOUSTIC_WORDS), "guitar_acoustic").when(guitar, "guitar_electric").when(joined.contains("bassdrum") | joined.contains("bassdrm"), "drums").when(has("bassoon"), "brass_winds")
        .when(has(BASS_WORDS) | joined.startswith("bass") | joined.contains("synthbass") | joined.contains("subbass"), "bass").when(has(SFX_WORDS), "sfx").when(has(DRUM_WORDS), "drums").when(has(VOCAL_WORDS), "vocals")
        .when(has(STRING_WORDS), "strings").when(has(WIND_WORDS), "brass_winds").when(has(EPIANO_WORDS) | (has("elec electric") & has("piano")), "keys_epiano").when(has(ORGAN_WORDS), "organ").when(has(PIANO_WORDS), "keys_piano")
        .when(has(PAD_WORDS), "synth_pad").when(has(LONE_LEAD_WORDS) | (has(LEAD_WORDS) & has(SYNTH_WORDS)), "synth_lead").when(has(SYNTH_WORDS), "synth_other").when(has(WEAK_DRUM_WORDS) & ~has(TONAL_WORDS), "drums").otherwise("other")
    )


def excluded(name: Column) -> Column:
    return any_of(tokens(name), EXCLUDED_WORDS)


def unknown(name: Column) -> Column:
    """No rule places the name, and it is not left out either."""
    return ~excluded(name) & (categorize(name) == "other") & ~any_of(tokens(name), TONAL_WORDS)


def guess_part(name: Column) -> Column:
    """kind, family, di, mic and the number right after a guitar word of a stem's file name."""
    wide = lambda c: F.when(c.startswith("guitar"), "guitar").when(c.startswith("keys") | (c == "organ"), "keys").when(c.startswith("synth"), "synth").otherwise(c)
    return held(tokens(name), lambda t: held(category_of(t), lambda c: held(wide(c), lambda family: part_of(t, family))))


def part_of(t: Column, family: Column) -> Column:
    """What guess_part tells of a name's tokens and its family."""
    di = F.array_contains(t, "di")
    after = F.filter(F.transform(t, lambda x, i: F.when(F.array_contains(F.array(*[F.lit(w) for w in GUITAR_WORDS.split()]), x), F.get(t, i + 1))), lambda x: x.rlike("^[0-9]+$"))
    kind = F.when(di & family.isin("guitar", "bass"), "di").when(family.isin("guitar", "bass", "vocals", "drums", "keys"), family).when(F.array_contains(t, "mix") & (family == "other"), "mix").otherwise("other")
    return F.struct(kind.alias("kind"), family.alias("family"), di.alias("di"), (family.isin("guitar", "bass") & any_of(t, MIC_WORDS)).alias("mic"), F.when(family == "guitar", F.get(after, F.lit(0)).try_cast("int")).alias("number"))


def guess_kind(percussion: Column, name: Column, program: Column, strings: Column, lowest: Column) -> Column:
    """guitar, bass or other from the flag, the name, the program and the strings of a track, in that order."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(percussion, "other").when(low.contains("bass"), "bass").when(low.rlike("guitar|gtr"), "guitar").when(program.between(24, 31), "guitar").when(program.between(32, 39), "bass")
        .when(strings.isin(4, 5) & (lowest < 40), "bass").when((strings >= 6) & program.isNull(), "guitar").otherwise("other")
    )


def family_of_program(program: Column) -> Column:
    out = F.lit(None).cast("string")
    for family, (a, b) in PROGRAMS.items():
        out = F.when(program.between(a, b), family).otherwise(out)
    return out


def family_of(cls: Column) -> Column:
    """The family of an instrument class; an unknown class is an error."""
    out = F.raise_error(F.concat(F.lit("unknown instrument class "), cls))
    for family, classes in FAMILIES.items():
        out = F.when(cls.isin(classes), family).otherwise(out)
    return out


def mask_members(present: Column, families: list[str]) -> Column:
    """The classes a transcriber is asked for, in a fixed order: all guitar classes and the present ones of the families."""
    order = [c for classes in FAMILIES.values() for c in classes]
    wanted = [c for f in families for c in FAMILIES[f]]
    keep = lambda c: F.lit(c in FAMILIES["guitar"]) | (F.array_contains(present, c) if c in wanted else F.lit(False))
    return F.filter(F.array(*[F.when(keep(c), F.lit(c)) for c in order]), lambda c: c.isNotNull())
