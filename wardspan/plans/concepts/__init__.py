"""Derived clinical tables."""

from wardspan.plans.concepts import base, care, severity  # noqa: F401
from wardspan.plans.concepts.registry import CONCEPTS, Catalog, build_concepts

# build order: a table comes after every table it reads
ORDER = """icustay_times icustay_hourly weight_durations urine_output kdigo_uo age icustay_detail bg blood_differential cardiac_marker
chemistry coagulation complete_blood_count creatinine_baseline enzyme gcs height icp inflammation oxygen_delivery rhythm
urine_output_rate ventilator_setting vitalsign charlson acei antibiotic arb dobutamine dopamine epinephrine milrinone neuroblock
norepinephrine nsaid phenylephrine vasopressin code_status crrt invasive_line rrt ventilation first_day_bg first_day_bg_art
first_day_gcs first_day_height first_day_lab first_day_rrt first_day_urine_output first_day_vitalsign first_day_weight
kdigo_creatinine meld apsiii lods oasis sapsii sirs sofa suspicion_of_infection kdigo_stages first_day_sofa sepsis3
vasoactive_agent norepinephrine_equivalent_dose""".split()

__all__ = ["CONCEPTS", "Catalog", "ORDER", "build_concepts"]
