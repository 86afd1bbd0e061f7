"""The rules of plant diagnosis as data; names are local to a namespace that the caller gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions.text import percent_encoded
from weftgraph.operators.rules import XSD, Iri, Lit, Rule

# Class, property and code names of the plant vocabulary, and the patterns of texts that rules look for.
SYSTEMATIC = "center|edge|ring|quadrant|reticle|field"
SYSTEMATIC_TEXT = SYSTEMATIC + "|中心|边缘|环形|象限|视场"


def catalog(namespace: str) -> list[Rule]:
    """All rules in the order they run."""

    def iri(name: str) -> Iri:
        return Iri(namespace + name)

    def made_by(rule_id: str, *derived: str) -> list[tuple]:
        return [("_:s", "generatedByRule", iri(f"rule:{rule_id}")), *(("_:s", "derivedFrom", d) for d in derived)]

    enables, evidence = "enablesRCAFor", "hasEvidence"
    return [
        Rule(
            "R-INF-003",
            [("?down", "impactsLot", "?lot"), ("_:s", "a", "Statement"), ("_:s", "subject", "?down"), ("_:s", "predicate", "impactsLot"), ("_:s", "object", "?lot"), *made_by("R-INF-003", "?down", "?run")],
            [
                *[("?down", "a", "DownEvent"), ("?down", "affectsEquipment", "?tool"), ("?down", "validFrom", "?from1"), ("?down", "validTo", "?to1")],
                *[("?run", "a", "ProcessingEvent"), ("?run", "usesEquipment", "?tool"), ("?run", "processesLot", "?lot"), ("?run", "validFrom", "?from2"), ("?run", "validTo", "?to2")],
            ],
            overlap=(("?from1", "?to1"), ("?from2", "?to2")),
        ),
        Rule(
            "R-INF-004",
            [("_:s", "a", "RootCauseHypothesis"), ("_:s", "hypothesizesCause", "?cause"), ("_:s", "hypothesizesAnomaly", "?anomaly"), *made_by("R-INF-004", "?cause", "?anomaly", "?playbook")],
            [("?cause", "mayCause", "?anomaly"), ("?playbook", "a", "DiagnosticPlaybook"), ("?playbook", "diagnosesAnomaly", "?anomaly")],
        ),
        Rule(
            "R-AUTO-RELEASE-GATE-BLOCKING-FINDING-ROUND1",
            [("?gate", "gateDecisionCode", Lit("BLOCK")), ("?gate", "releaseBlockingFlag", Lit("true"))],
            [("?gate", "a", "ReleaseGate"), ("?gate", "hasValidationFinding", "?finding"), ("?finding", "a", "ValidationFinding"), ("?finding", "releaseBlockingFlag", "?flag")],
            filter=lambda v: F.lower(v("?flag")).isin("true", "1"),
            unless=[("?gate", "gateDecisionCode", "?decided")],
        ),
        Rule(
            "R-AUTO-VALIDATION-NONCONFORMING-REPORT-BLOCK-R1",
            [("?report", "releaseBlockingFlag", Lit("true", XSD + "boolean"))],
            [("?report", "a", "OntologyValidationReport"), ("?report", "ontologyReportConforms", "?conforms"), ("?report", "hasValidationFinding", "?finding"), ("?finding", "a", "ConstraintViolationValidationResult")],
            filter=lambda v: F.lower(v("?conforms")) == "false",
        ),
        Rule(
            "R-AUTO-VALIDATION-WARNING-REVIEW-R1",
            [("?report", "validationStatus", Lit("review_required"))],
            [("?report", "a", "OntologyValidationReport"), ("?report", "ontologyWarningCount", "?warnings")],
            filter=lambda v: v("?warnings").try_cast("bigint") > 0,
            unless=[("?report", "validationStatus", "?status")],
        ),
        Rule(
            "R-AUTO-FAB-RCA-TELEMETRY-ANOMALY-REPAIR3",
            [("?flow", enables, "?anomaly")],
            [("?flow", "a", "RCAEvidenceIntegrationPattern"), ("?flow", "integratesEvidenceFrom", "?source"), ("?source", "a", "SourceArtifact"), ("?flow", "diagnosesAnomaly", "?anomaly"), ("?anomaly", "a", "QualityExcursionAnomaly")],
            filter=lambda v: F.lower(v("?source")).contains("sixsense") | F.lower(v("?source")).contains("telemetry"),
        ),
        Rule(
            "R-AUTO-CROSS-SYSTEM-RCA-ENABLEMENT-02",
            [("?inquiry", enables, "?anomaly")],
            [("?inquiry", "a", "CrossSystemRCAInvestigation"), ("?inquiry", "diagnosesAnomaly", "?anomaly"), ("?inquiry", "correlatesFactorySourceArtifact", "?source"), ("?anomaly", "a", "QualityExcursionAnomaly"), ("?source", "a", "SourceArtifact")],
            unless=[("?inquiry", enables, "?anomaly")],
        ),
        Rule(
            "R-AUTO-CROSS-SYSTEM-EVIDENCE-CLOSURE-001",
            [("?inquiry", evidence, "?proof")],
            [("?inquiry", "a", "CrossSystemEvidenceIntegratedRCAInvestigation"), ("?inquiry", "hasEvidenceIntegrationPattern", "?pattern"), ("?pattern", "a", "CrossSystemEvidenceIntegrationPattern"), ("?pattern", "integratesEvidenceFrom", "?proof"), ("?proof", "a", "Evidence")],
        ),
        Rule(
            "R-AUTO-EQP-EVIDENCE-LINK-001",
            [("?flow", evidence, "?signal")],
            [("?flow", "a", "AIEnabledRootCauseAnalysisWorkflow"), ("?flow", "integratesEvidenceFrom", "?signal"), ("?signal", "a", "SECSGEMEquipmentTelemetryEvidence")],
            unless=[("?flow", evidence, "?signal")],
        ),
        Rule("R-AUTO-EVIDENCE-INTEGRATION-SECSGEM-001", [("?flow", "integratesEvidenceFrom", "?proof")], [("?flow", "fusesSECSGEMTelemetryEvidence", "?proof")]),
        Rule("R-AUTO-DIAGNOSIS-ENABLES-RCA-001", [("?flow", enables, "?anomaly")], [("?flow", "diagnosesAnomaly", "?anomaly"), ("?anomaly", "a", "Anomaly")], unless=[("?flow", enables, "?anomaly")]),
        Rule(
            "R-AUTO-EQP-001",
            [("?anomaly", "correlatesMaintenanceLogEvidence", "?log")],
            [
                *[("?anomaly", "a", "EquipmentDowntimeAnomaly"), ("?anomaly", "affectsEquipment", "?tool"), ("?anomaly", evidence, "?signal"), ("?signal", "a", "SECSGEMEquipmentTelemetryEvidence")],
                *[("?repair", "a", "CorrectiveMaintenanceEvent"), ("?repair", "affectsEquipment", "?tool"), ("?repair", evidence, "?log"), ("?log", "a", "MaintenanceLogCorrelationEvidence")],
            ],
        ),
        Rule(
            "R-AUTO-EQP-ALARM-DOWNTIME-MAINTENANCE-EVIDENCE-001",
            [("?chain", "a", "EQPAlarmMaintenanceCorrelationRecord"), ("?chain", "aboutEntity", "?tool"), ("?chain", "integratesEvidenceFrom", "?log")],
            [
                *[("?alarm", "a", "AlarmEvent"), ("?alarm", "affectsEquipment", "?tool"), ("?down", "a", "EquipmentDowntimeAnomaly"), ("?down", "affectsEquipment", "?tool")],
                *[("?repair", "a", "CorrectiveMaintenanceEvent"), ("?repair", "affectsEquipment", "?tool"), ("?repair", "correlatesMaintenanceLogEvidence", "?log")],
            ],
            mint=("?chain", lambda v: F.concat(F.lit(namespace + "derived:eqp-correlation:"), F.sha2(F.concat_ws("|", v("?alarm"), v("?down"), v("?repair"), v("?log")), 256))),
            mint_apart=True,
        ),
        Rule(
            "R-AUTO-EQP-FORECAST-WARNING-TARGET-001",
            [("?warning", "a", "PredictedEquipmentFailureWarning"), ("?warning", "forecastsFailureOfEquipment", "?tool")],
            [("?flow", "a", "SensorTimeSeriesEquipmentFailureForecastingWorkflow"), ("?flow", "forecastsEquipmentFailureWarning", "?warning"), ("?warning", "affectsEquipment", "?tool")],
            unless=[("?warning", "forecastsFailureOfEquipment", "?tool")],
        ),
        Rule(
            "R-AUTO-QUALITY-EVIDENCE-LOT-IMPACT-R1",
            [("?anomaly", "impactsLot", "?lot")],
            [("?anomaly", "a", "QualityExcursionAnomaly"), ("?anomaly", evidence, "?seen"), ("?seen", "a", "Observation"), ("?seen", "aboutEntity", "?lot"), ("?lot", "a", "Lot")],
            unless=[("?anomaly", "impactsLot", "?lot")],
        ),
        Rule(
            "R-AUTO-EQP-DOWN-STATUS-ANOMALY-001",
            [("?down", "a", "EquipmentDowntimeAnomaly"), ("?down", "affectsEquipment", "?tool")],
            [("?tool", "a", "Equipment"), ("?tool", "hasStatusEvent", "?down"), ("?down", "a", "DownEvent")],
        ),
        Rule(
            "R-AUTO-FAB-DT-MONITORING-RCA-LINK",
            [("?twin", enables, "?anomaly")],
            [("?twin", "a", "FacilityDigitalTwin"), ("?twin", "hasCapability", "?skill"), ("?skill", "analyzesTimeSeriesObservation", "?seen"), ("?skill", "diagnosesAnomaly", "?anomaly")],
        ),
        Rule(
            "R-AUTO-FAC-DT-UTILITY-SUBSYSTEM-001",
            [("?twin", "hasSubsystem", "?utility")],
            [("?twin", "a", "FacilityDigitalTwin"), ("?twin", "hasPart", "?platform"), ("?platform", "a", "UtilityIntegrationPlatform"), ("?platform", "aggregatesUtilityData", "?utility"), ("?utility", "a", "UtilitySystem")],
        ),
        Rule(
            "R-AUTO-EQP-MAINTENANCE-EVIDENCE-LINK",
            [("?anomaly", "correlatesMaintenanceLogEvidence", "?log")],
            [("?anomaly", "a", "EquipmentDowntimeAnomaly"), ("?anomaly", "affectsEquipment", "?tool"), ("?repair", "a", "MaintenanceEvent"), ("?repair", "affectsEquipment", "?tool"), ("?repair", evidence, "?log"), ("?log", "a", "MaintenanceLogCorrelationEvidence")],
        ),
        Rule(
            "R-AUTO-YIELD-WAFERMAP-SYSTEMATIC-PATTERN",
            [("?seen", "classifiesYieldLossMode", iri("yieldLossMode:systematic"))],
            [("?seen", "a", "WaferMapSpatialPatternObservation")],
            either=[
                ([("?seen", "patternCategoryCode", "?code")], lambda v: F.lower(v("?code")).rlike(SYSTEMATIC)),
                ([("?seen", "signalText", "?words")], lambda v: F.lower(v("?words")).rlike(SYSTEMATIC_TEXT)),
            ],
            unless=[("?seen", "classifiesYieldLossMode", "?mode")],
        ),
        Rule(
            "R-AUTO-EQP-TS-FORECAST-LINK-001",
            [("?monitor", "feedsFailureForecasting", iri("eqpFailureForecastWorkflowDemo01"))],
            [("?monitor", "a", "SensorDrivenRealTimeEquipmentMonitoring"), ("?monitor", "analyzesTimeSeriesObservation", "?seen"), ("?seen", "a", "Observation")],
            unless=[("?monitor", "feedsFailureForecasting", iri("eqpFailureForecastWorkflowDemo01"))],
        ),
        Rule(
            "R-AUTO-FAB-MES-TRACE-COMPLETENESS-001",
            [("?record", "a", "FabMESOperationalTraceCompletenessReview"), ("?record", "aboutEntity", "?record")],
            [("?record", "a", "FabMESOperationalTraceRecord"), ("?record", "integratesEvidenceFrom", "?source"), ("?source", "sourceType", Lit("web"))],
        ),
        Rule(
            "R-AUTO-FAC-SIGNAL-CONTEXT-r2a08",
            [("?twin", evidence, "?bundle"), ("?bundle", "aboutEntity", "?twin"), ("?bundle", "a", "FacilityOperationalEvidenceBundle_r2a08")],
            [("?map", "a", "FacilitySignalAssetMappingRecord_r2a08"), ("?map", "mapsFacilitySignalToZone_r2a08", "?zone"), ("?map", "mapsFacilitySignalToAsset_r2a08", "?asset"), ("?twin", "a", "FacilityDigitalTwin")],
            mint=("?bundle", lambda v: F.concat(v("?twin"), F.lit("/evidence-bundle/"), percent_encoded(v("?map")))),
        ),
        Rule(
            "R-AUTO-FAB-RCA-EVIDENCE-001",
            [("?flow", enables, "?anomaly")],
            [("?flow", "a", "AIEnabledRootCauseAnalysisWorkflow"), ("?flow", "integratesEvidenceFrom", "?proof"), ("?flow", "diagnosesAnomaly", "?anomaly"), ("?anomaly", "a", "Anomaly")],
        ),
    ]
