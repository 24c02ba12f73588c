"""The registry of metrics and their normalisation curves: fixed values.

Twelve distances and counts, eight accessibility indices; each has one curve.
"""

from __future__ import annotations

INDEX = [(0, 0), (0.1, 10), (0.25, 25), (0.5, 50), (0.75, 75), (0.9, 90), (1, 100)]

# metric: (provider, category, config, curve)
METRICS = {
    "education.kindergarten.count_1000m": ("count_within_radius", "education.kindergarten", {"radius": 1000}, [(0, 0), (1, 40), (2, 55), (4, 75), (6, 90), (10, 100)]),
    "education.kindergarten.distance_m": ("nearest_distance", "education.kindergarten", {}, [(0, 100), (300, 100), (700, 80), (1200, 50), (2000, 20), (3000, 0)]),
    "education.school.count_1000m": ("count_within_radius", "education.school", {"radius": 1000}, [(0, 0), (1, 50), (2, 65), (3, 75), (5, 90), (8, 100)]),
    "education.school.distance_m": ("nearest_distance", "education.school", {}, [(0, 100), (500, 100), (1000, 75), (1500, 50), (2500, 20), (4000, 0)]),
    "healthcare.clinic.distance_m": ("nearest_distance", "healthcare.clinic", {}, [(0, 100), (500, 100), (1000, 80), (2000, 50), (4000, 20), (8000, 0)]),
    "healthcare.hospital.distance_m": ("nearest_distance", "healthcare.hospital", {}, [(0, 100), (1000, 100), (2500, 80), (5000, 50), (8000, 20), (12000, 0)]),
    "healthcare.pharmacy.count_1000m": ("count_within_radius", "healthcare.pharmacy", {"radius": 1000}, [(0, 0), (1, 45), (2, 60), (4, 80), (8, 95), (12, 100)]),
    "healthcare.pharmacy.distance_m": ("nearest_distance", "healthcare.pharmacy", {}, [(0, 100), (300, 100), (600, 80), (1000, 55), (2000, 20), (3000, 0)]),
    "nature.park.distance_m": ("nearest_distance", "nature.park", {}, [(0, 100), (300, 100), (600, 85), (1000, 65), (1500, 40), (2500, 15), (4000, 0)]),
    "nature.water.distance_m": ("nearest_distance", "nature.water", {}, [(0, 100), (300, 100), (800, 80), (1500, 50), (3000, 20), (5000, 0)]),
    "transport.stop.count_500m": ("count_within_radius", "transport.stop", {"radius": 500}, [(0, 0), (1, 30), (3, 50), (5, 65), (10, 85), (20, 100)]),
    "transport.stop.distance_m": ("nearest_distance", "transport.stop", {}, [(0, 100), (200, 100), (400, 85), (600, 65), (1000, 30), (1500, 0)]),
    "education.kindergarten.accessibility_index": ("primary_accessibility", "education.kindergarten", {"half": 600, "cutoff": 4, "cap": 0.18, "saturation": 1.0}, INDEX),
    "education.school.accessibility_index": ("primary_accessibility", "education.school", {"half": 700, "cutoff": 4, "cap": 0.18, "saturation": 1.0}, INDEX),
    "transport.stop.accessibility_index": ("primary_accessibility", "transport.stop", {"half": 350, "cutoff": 4, "cap": 0.18, "saturation": 1.0}, INDEX),
    "healthcare.clinic.accessibility_index": ("primary_accessibility", "healthcare.clinic", {"half": 1000, "cutoff": 4, "cap": 0.18, "saturation": 1.0}, INDEX),
    "healthcare.hospital.accessibility_index": ("primary_accessibility", "healthcare.hospital", {"half": 2000, "cutoff": 4, "cap": 0.18, "saturation": 1.0}, INDEX),
    "healthcare.pharmacy.accessibility_index": ("primary_accessibility", "healthcare.pharmacy", {"half": 500, "cutoff": 4, "cap": 0.18, "saturation": 1.0}, INDEX),
    "nature.park.accessibility_index": ("park_accessibility", "nature.park", {"half": 900, "cutoff": 4, "cap": 0.15, "saturation": 0.75, "area_ref": 50_000, "min_quality": 0.2}, INDEX),
    "nature.water.accessibility_index": ("water_accessibility", "nature.water", {"half": 1000, "cutoff": 4, "area_ref": 100_000, "min_quality": 0.25, "line_quality": 0.85}, INDEX),
}


def definitions(config: dict | None = None) -> list[dict]:
    """The registry as ``metrics.run_metrics`` takes it; ``config`` is added to each definition's own."""
    return [{"key": k, "provider": p, "category": c, "config": own | (config or {})} for k, (p, c, own, _) in METRICS.items()]


def curves() -> dict[str, list[tuple[float, float]]]:
    return {k: points for k, (*_, points) in METRICS.items()}
