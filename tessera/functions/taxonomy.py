"""Tag identities, categories, counts and exclusion rules, as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Category codes of the sources, and the prefix that each category puts before a raw name.
CATEGORY_CODES = {0: "general", 1: "artist", 3: "series", 4: "character", 5: "meta"}
PREFIXED = ("artist", "series", "character", "meta")
#: Identities of the meta category that are kept all the same.
DEFAULT_INCLUDES = (
    "meta:scan", "meta:magazine_scan", "meta:self-scan",
    "meta:traditional_media", "meta:mixed_media", "meta:vector_art", "meta:colorized",
    "meta:cosplay_photo", "meta:anime_screenshot", "meta:game_screenshot", "meta:game_asset", "meta:game_model",
    "meta:ai-generated", "meta:ai-generated_background", "meta:ai-assisted",
    "meta:stable_diffusion", "meta:midjourney", "meta:nai_diffusion", "meta:dall-e", "meta:tensor_art",
)
MEDIUM_SUFFIX = "_(medium)"


def category_of(code: Column) -> Column:
    """Category of a source's code; unknown and missing codes are general."""
    out = F.lit("general")
    for number, name in CATEGORY_CODES.items():
        out = F.when(code == number, F.lit(name)).otherwise(out)
    return out


def identity(raw: Column, category: Column) -> Column:
    return F.when(category.isin(*PREFIXED), F.concat(category, F.lit(":"), raw)).otherwise(raw)


def raw_name(name: Column) -> Column:
    return F.regexp_replace(name, f"^({'|'.join(PREFIXED)}):", "")


def category_in(name: Column) -> Column:
    found = F.regexp_extract(name, f"^({'|'.join(PREFIXED)}):", 1)
    return F.when(found == "", F.lit("general")).otherwise(found)


def best_count(a: Column, b: Column) -> Column:
    return F.greatest(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0)))


@dataclass(frozen=True)
class ExclusionRules:
    """Hand-written rules: a few hundred lines of a file at most, so they travel inside the expression."""

    excludes: frozenset[str] = frozenset()
    includes: frozenset[str] = frozenset(DEFAULT_INCLUDES)

    @classmethod
    def parse(cls, lines) -> ExclusionRules:
        """Blank lines and those with ``#`` say nothing, ``!name`` includes, any other excludes."""
        said = [x.strip() for x in lines]
        said = [x for x in said if x and not x.startswith("#")]
        return cls(frozenset(x for x in said if not x.startswith("!")), frozenset(x[1:].strip() for x in said if x.startswith("!")))

    def lines(self) -> list[str]:
        return [*sorted(self.excludes), *[f"!{x}" for x in sorted(self.includes)]]

    def excluded(self, name: Column) -> Column:
        """The first that applies decides: included by name, excluded by name, a medium, the meta category."""
        def among(names: frozenset[str]) -> Column:
            return name.isin(*sorted(names)) if names else F.lit(False)

        return F.when(among(self.includes), False).when(among(self.excludes), True).when(raw_name(name).endswith(MEDIUM_SUFFIX), False).otherwise(name.startswith("meta:"))


def eligible(tags: DataFrame, min_images: int, rules: ExclusionRules = ExclusionRules(), name: str = "name", best: str = "best_count") -> DataFrame:
    return tags.where((F.col(best) >= min_images) & ~rules.excluded(F.col(name)))
