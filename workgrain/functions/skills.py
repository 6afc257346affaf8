"""Skill terms in free text and the gap between two skill sets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# The skill terms, in the order results list them.
SKILLS = (
    "react", "reactjs", "react native", "angular", "vue", "vuejs", "nextjs", "nuxt",
    "svelte", "node", "nodejs", "express", "nest", "nestjs", "django", "flask",
    "fastapi", "spring boot", "laravel", "ruby on rails", ".net", "asp.net", "python",
    "java", "javascript", "typescript", "c++", "c#", "php", "ruby", "go", "golang",
    "rust", "swift", "kotlin", "aws", "azure", "gcp", "google cloud", "docker",
    "kubernetes", "k8s", "terraform", "ansible", "jenkins", "github actions", "mysql",
    "postgresql", "postgres", "mongodb", "redis", "elasticsearch", "cassandra",
    "oracle", "sql server", "graphql", "rest api", "grpc", "rabbitmq", "kafka",
    "machine learning", "deep learning", "nlp", "computer vision", "data science",
    "data engineering", "pytorch", "tensorflow", "scikit-learn", "pandas", "numpy",
    "html", "css", "sass", "less", "tailwind", "bootstrap", "figma", "ui/ux", "agile",
    "scrum", "jira", "confluence",
)
# Terms with symbols, found anywhere rather than as whole words.
ANYWHERE = ("c++", "c#", ".net")


WORDS = tuple(s for s in SKILLS if s.isalnum())
PHRASES = tuple(s for s in SKILLS if not s.isalnum() and s not in ANYWHERE)


def extract_skills(c: Column) -> Column:
    """Array of the skills a text names, in list order; empty for null text.

    One-word skills are looked up in the set of the text's words. Only a text
    that holds the first word of a phrase is searched for the phrase itself.
    """
    low = F.lower(F.coalesce(c, F.lit("")))
    heads = {skill: re.match("[a-z0-9]+", skill)[0] for skill in PHRASES}

    def found(named: Column) -> Column:
        phrases = [
            F.when(
                F.array_contains(named, heads[skill]) & low.rlike(f"(?<![A-Za-z0-9_]){skill}(?![A-Za-z0-9_])"),
                F.lit(skill),
            )
            for skill in PHRASES if "." not in skill
        ]
        # A dot in a term stands for any character, so its words may run together.
        dotted = [
            F.when(
                low.contains(heads[skill]) & low.rlike(f"(?<![A-Za-z0-9_]){skill}(?![A-Za-z0-9_])"),
                F.lit(skill),
            )
            for skill in PHRASES if "." in skill
        ]
        anywhere = [F.when(low.contains(skill), F.lit(skill)) for skill in ANYWHERE]
        every = F.array(*[F.lit(skill) for skill in SKILLS])
        return F.array_intersect(every, F.concat(named, F.array(*phrases, *dotted, *anywhere)))

    wanted = F.array(*[F.lit(w) for w in sorted({*WORDS, *heads.values()})])
    named = F.array_intersect(wanted, F.split(low, "[^a-z0-9_]+"))
    return let(named, found)


def skill_gap(cv_skills: Column, job_skills: Column) -> Column:
    """Struct (matched, missing, percentage); no percentage when the job names no skill."""
    matched = F.array_intersect(job_skills, cv_skills)
    total = F.size(job_skills)
    share = F.floor(F.size(matched) * F.lit(100.0) / F.nullif(total, F.lit(0)) + 0.5)
    return F.struct(
        matched.alias("matched"),
        F.array_except(job_skills, cv_skills).alias("missing"),
        share.cast("int").alias("percentage"),
    )
