"""Sectors: patterns that speak for one, what is special in it, and old names for it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import classified
from .rules import lookup, once

STRONG, WEAK = 3, 1
# Patterns by sector; a strong one counts three, a weak one counts one. Upper case is meant where no (?i) is.
SECTOR_RULES = {
    "frontier": (
        (
            r"(?i)\brobot(ic|ics|s)?\b", r"(?i)\bhumanoid\b", r"(?i)\bcobot\b", r"(?i)\bautonomous\s+(vehicle|mobile\s+robot|drone)", r"(?i)\bwarehouse\s+automation\b", r"(?i)\bteleoperat",
            r"(?i)\bspace\s?(tech|craft|flight)\b", r"(?i)\bsatellite", r"(?i)\borbit(al)?\b", r"(?i)\blaunch\s+vehicle\b",
            r"(?i)\bearth\s+observation\b", r"(?i)\bin-?space\b", r"(?i)\bconstellation\s+of\s+satellites\b",
            r"(?i)\brocket\s+(?:engine|motor|propulsion|stage)\b", r"(?i)\brockets?\b", r"(?i)\bhypersonic\b",
            r"(?i)\bspaceport\b", r"(?i)\blunar\b", r"(?i)\bre-?entry\s+vehicle\b", r"(?i)\bspace\s+station\b",
            r"(?i)\bdeep\s+space\b",
        ),
        (
            r"(?i)\bactuator", r"(?i)\bmanipulat(or|ion)\b", r"(?i)\bgripper", r"(?i)\bdrone\b", r"(?i)\bLiDAR\b", r"(?i)\bmotion\s+planning\b", r"(?i)\bfleet\s+of\s+machines\b",
            r"(?i)\baerospace\b", r"(?i)\bgeospatial\b", r"(?i)\bremote\s+sensing\b", r"(?i)\bground\s+station\b", r"(?i)\bpayload\b", r"\bLEO\b", r"(?i)\bpropulsion\b",
        ),
    ),
    "health": (
        (r"(?i)\bhealth(care)?\b", r"(?i)\bclinic(al|s)?\b", r"(?i)\bpatient", r"(?i)\bmedical\b", r"(?i)\bdiagnos(is|tic)", r"(?i)\btherapeutic", r"(?i)\boncolog", r"(?i)\bmental\s+health\b", r"(?i)\bgenomic", r"(?i)\bbiotech", r"\bEHR\b", r"(?i)\btelehealth\b"),
        (r"(?i)\bwellness\b", r"(?i)\bcare\s+(team|coordination|delivery)\b", r"(?i)\bprovider(s)?\b", r"(?i)\bpharma", r"(?i)\bnurse", r"(?i)\blongevity\b"),
    ),
    "fintech": (
        (r"(?i)\bfintech\b", r"(?i)\bpayment(s)?\b", r"(?i)\bbanking\b", r"(?i)\blending\b", r"(?i)\bcredit\s+(card|union|score)\b", r"(?i)\binsur(ance|tech)\b", r"(?i)\bwealth\s+management\b", r"(?i)\bpayroll\b", r"(?i)\bunderwrit", r"(?i)\bremittance"),
        (r"(?i)\bfinanc(e|ial)\b", r"(?i)\btreasury\b", r"(?i)\bledger\b", r"(?i)\bcompliance\b", r"\bKYC\b", r"(?i)\binvest(ing|ment)\b", r"(?i)\bcapital\s+markets\b"),
    ),
    "sustainability": (
        (r"(?i)\bdecarboniz", r"(?i)\bclimate\s?(tech)?\b", r"(?i)\brenewable", r"(?i)\bsolar\b", r"(?i)\bwind\s+(power|farm|energy)\b", r"(?i)\bgeothermal\b", r"(?i)\bhydrogen\b", r"(?i)\bcarbon\s+(capture|credit|removal)\b", r"(?i)\bgrid\b", r"(?i)\bEV\s+charging\b"),
        (r"(?i)\benergy\b", r"(?i)\bemission", r"(?i)\bsustainab", r"(?i)\bbattery\b", r"(?i)\brecycl", r"(?i)\bnuclear\b"),
    ),
    "fow": (
        (
            r"(?i)\bfuture\s+of\s+work\b", r"(?i)\bcopilot\b", r"(?i)\bworkflow\s+automation\b", r"(?i)\bhiring\b", r"(?i)\brecruit",
            r"(?i)\bHR\s+(tech|platform|software)\b", r"(?i)\bfrontline\s+worker", r"(?i)\bemployee\s+(experience|engagement|onboarding)\b",
            r"(?i)\bproductivity\s+(tool|platform)\b",
            r"(?i)\bapplicant\s+tracking\b", r"(?i)\bworkforce\s+management\b", r"(?i)\bshift\s+(?:scheduling|swap|management)\b",
            r"(?i)\bupskill", r"(?i)\breskill", r"(?i)\bperformance\s+(?:review|management)\s+(?:software|platform|tool)\b",
            r"(?i)\btalent\s+(?:marketplace|acquisition|platform)\b", r"(?i)\bstaffing\s+(?:platform|marketplace|agency\s+software)\b",
            r"(?i)\blearning\s+management\b", r"(?i)\bdeskless\s+worker", r"(?i)\bwage\s+access\b", r"(?i)\btime\s+(?:and\s+attendance|tracking\s+software)\b",
            r"(?i)\bfoundation\s+model", r"\bLLM(s)?\b", r"(?i)\blarge\s+language\s+model",
            r"(?i)\binference\s+(engine|infrastructure|serving)\b", r"(?i)\bvector\s+(database|search)\b",
            r"(?i)\bfine-?tun", r"\bRAG\b", r"(?i)\bAI\s+(infrastructure|tooling|observability|evaluation|safety)\b",
            r"(?i)\bMLOps\b", r"(?i)\bmachine\s+learning\s+(platform|infrastructure)\b",
            r"(?i)\b(?:voice|speech|video|image|world|code|coding)\s+model(s)?\b",
            r"(?i)\bAI\s+(?:voice|video|image|coding|agent)\s+(?:model|platform|assistant|tool)",
            r"(?i)\bagentic\s+(?:infrastructure|runtime|platform)\b", r"(?i)\bmodel\s+(?:serving|weights|training)\b",
            r"(?i)\bAI-generated\s+content\s+detection\b", r"(?i)\bAI\s+coding\s+(?:assistant|agent|tool)\b",
        ),
        (
            r"(?i)\bcollaborat", r"(?i)\bteam(s)?\s+(tool|platform)\b", r"(?i)\bknowledge\s+(base|work)\b", r"(?i)\bscheduling\b", r"(?i)\bfreelanc", r"(?i)\bcontractor", r"(?i)\bonboarding\b", r"(?i)\bemployer\b",
            r"\bAI\b", r"(?i)\bartificial\s+intelligence\b", r"(?i)\bneural\s+net", r"(?i)\bmodel\s+training\b", r"\bGPU\b", r"(?i)\bagent(ic|s)?\b", r"(?i)\bdeep\s+learning\b",
        ),
    ),
}
# What is special in each sector; the first that matches tells.
SUBVERTICALS = {
    "health": (
        ("clinical trial infrastructure", "clinical trial"), ("drug discovery", "drug discovery"), ("behavioral health", "mental health|behavioral health"),
        ("virtual care delivery", "telehealth|remote patient"), ("health data and claims infrastructure", "electronic health record|ehr|claims"),
        ("medical devices", "medical device|surgical"), ("genomics and diagnostics", "genomics|biomarker"),
        ("health benefits infrastructure", "copay|benefit design|formulary|deductible|plan design"), ("consumer wellness", "nutrition|fitness|wellness"),
    ),
    "fintech": (
        ("payments infrastructure", "payments|card issuing|interchange"), ("lending and credit", "lending|underwriting|credit"), ("insurtech", "insurance"),
        ("finance and back office automation", "payroll|accounting|invoice|tax"), ("financial crime and compliance", "kyc|aml|fraud|compliance"),
        ("wealth and capital markets", "wealth|brokerage|capital markets"), ("treasury and ledger infrastructure", "treasury|reconciliation|ledger"),
    ),
    "sustainability": (
        ("carbon accounting and removal", "carbon|emissions|greenhouse|net zero"), ("clean energy and grid", "solar|wind|renewable|grid|energy storage|battery"),
        ("electrification", "ev charging|electrification|heat pump"), ("circular economy and waste", "recycling|waste|circular"),
        ("water technology", "water"), ("agriculture technology", "agriculture|regenerative|farm"),
    ),
    "frontier": (
        ("warehouse and logistics robotics", "warehouse|fulfillment|logistics"), ("aerial systems", "drone|uav"), ("autonomous vehicles", "autonomous vehicle|self-driving"),
        ("general-purpose and collaborative robots", "humanoid|manipulator|cobot"), ("surgical robotics", "surgical robot"), ("agricultural robotics", "agriculture|harvest"),
        ("launch and propulsion", "launch|rocket|propulsion"), ("earth observation", "earth observation|remote sensing|imagery"),
        ("satellite systems", "satellite|constellation|smallsat|cubesat"), ("ground segment", "ground station|downlink"), ("in-orbit services", "in-orbit|servicing|debris"),
    ),
    "fow": (
        ("talent acquisition", "hiring|recruiting|talent acquisition"), ("learning and development", "training|upskilling|learning"),
        ("HR operations", "benefits|payroll|hr platform|people operations"), ("frontline workforce management", "frontline|shift|scheduling"),
        ("workplace collaboration", "collaboration|productivity|knowledge"), ("foundation models", "foundation model|large language model|model training"),
        ("AI infrastructure", "inference|gpu|mlops|ai infrastructure"), ("agent platforms", "agent framework|agents"),
        ("retrieval and data infrastructure", "vector database|retrieval"), ("model evaluation and safety", "evaluation|guardrail|safety"),
        ("perception platforms", "computer vision platform|speech recognition"),
    ),
}
# Old names of sectors.
OLD_NAMES = {"robotics": "frontier", "spacetech": "frontier", "space-tech": "frontier", "space_tech": "frontier", "space tech": "frontier", "ai": "fow"}


def sector_of(*texts: Column, least: int = STRONG) -> Column:
    """struct<label, score, confidence>: the sector that the joined texts speak for; a weak hit alone speaks for none."""
    every = F.concat_ws(" \n ", *(F.nullif(t, F.lit("")) for t in texts))
    rules = {sector: [*((p, STRONG) for p in strong), *((p, WEAK) for p in weak)] for sector, (strong, weak) in SECTOR_RULES.items()}
    return classified(every, rules, least)


def subvertical_of(sector: Column, text: Column) -> Column:
    """What of its sector a text is about; null if nothing special shows."""
    found = lambda low, rows: F.coalesce(*(F.when(low.rlike(p), F.lit(label)) for label, p in rows))
    return once(F.lower(text), lambda low: F.coalesce(*(F.when(sector == s, found(low, rows)) for s, rows in SUBVERTICALS.items())))


def sector_id(raw: Column) -> Column:
    """The id of a sector, whatever case or old name it is given by; null if unknown."""
    key = F.lower(F.trim(raw))
    return F.coalesce(F.when(key.isin(*SECTOR_RULES), key), lookup(key, OLD_NAMES))
