"""Datasets, their tasks, aliases and label transformers."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class DatasetSpec:
    """Which columns of a labelled table play which part."""

    feature: str
    tasks: tuple[str, ...]
    id: str
    weight: str | None = None
    extra: tuple[str, ...] = field(default=())


# Task columns of the public benchmark datasets.
TASKS = {
    "bbbp": ("p_np",),
    "bace_classification": ("Class",),
    "clintox": ("FDA_APPROVED", "CT_TOX"),
    "hiv": ("HIV_active",),
    "tox21": (
        "NR-AR", "NR-AR-LBD", "NR-AhR", "NR-Aromatase", "NR-ER", "NR-ER-LBD",
        "NR-PPAR-gamma", "SR-ARE", "SR-ATAD5", "SR-HSE", "SR-MMP", "SR-p53",
    ),
    "sider": (
        "Hepatobiliary disorders",
        "Metabolism and nutrition disorders",
        "Product issues",
        "Eye disorders",
        "Investigations",
        "Musculoskeletal and connective tissue disorders",
        "Gastrointestinal disorders",
        "Social circumstances",
        "Immune system disorders",
        "Reproductive system and breast disorders",
        "Neoplasms benign, malignant and unspecified (incl cysts and polyps)",
        "General disorders and administration site conditions",
        "Endocrine disorders",
        "Surgical and medical procedures",
        "Vascular disorders",
        "Blood and lymphatic system disorders",
        "Skin and subcutaneous tissue disorders",
        "Congenital, familial and genetic disorders",
        "Infections and infestations",
        "Respiratory, thoracic and mediastinal disorders",
        "Psychiatric disorders",
        "Renal and urinary disorders",
        "Pregnancy, puerperium and perinatal conditions",
        "Ear and labyrinth disorders",
        "Cardiac disorders",
        "Nervous system disorders",
        "Injury, poisoning and procedural complications",
    ),
    "delaney": ("measured log solubility in mols per litre",),
    "freesolv": ("y",),
    "lipo": ("exp",),
    "clearance": ("target",),
    "bace_regression": ("pIC50",),
}

# Other names the same datasets go by.
ALIASES = {
    "esol": "delaney",
    "bace": "bace_classification",
    "bace_c": "bace_classification",
    "bace_r": "bace_regression",
}

# Label transformers by dataset.
TRANSFORMERS = {
    "delaney": ("normalization",),
    "freesolv": ("normalization",),
    "lipo": ("normalization",),
    "clearance": ("log",),
    "bace_regression": ("normalization",),
}

# Classifications whose classes are weighed alike.
BALANCED = ("bace_classification", "bbbp", "hiv", "tox21")

# Number of input chunks by library size.
LIBRARY_CHUNKS = {"100m": 10, "250m": 25, "500m": 50, "1b": 100}


def resolve(name: str) -> str:
    """Canonical dataset name."""
    return ALIASES.get(name, name)
