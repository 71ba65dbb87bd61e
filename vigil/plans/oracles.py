"""Registry of oracle SQL strings, keyed like ``catalog.QUERIES``."""

from __future__ import annotations

from . import oracle_sql as O

ORACLES: dict[str, str] = {
    "drift_scan": O.drift_scan_sql(),
    "drift_psi": O.drift_psi_sql(),
    "drift_ks": O.drift_ks_sql(),
    "health_snapshot": O.health_sql(),
    "latest_per_model": O.latest_sql(),
    "liveness": O.liveness_sql(),
    "distinct_models": O.distinct_models_sql(),
    "bucket_1m": O.bucket_1m_sql(),
    "bucket_15m": O.bucket_15m_sql(),
    "panel_legend": O.panel_legend_sql(),
    "anomaly_score_panel": O.anomaly_panel_sql(),
    "psi_panel": O.psi_panel_sql(),
    "rtf_panel": O.rtf_panel_sql(),
    "latency_panels": O.latency_panels_sql(),
    "gpu_heatmap": O.gpu_heatmap_sql(),
    "counter_rate": O.counter_rate_sql(),
    "avg_tokens_per_request": O.avg_tokens_sql(),
    "vram_util": O.vram_sql(),
    "compare_stats": O.compare_stats_sql(),
    "compare_welch": O.compare_welch_sql(),
    "root_cause": O.root_cause_rows_sql(),
    "root_cause_latest": O.root_cause_latest_sql(),
    "threshold_alerts": O.threshold_alerts_sql(),
    "drift_alerts": O.drift_alerts_sql(),
    "external_alerts": O.external_alerts_sql(),
    "alert_feed": O.alert_feed_sql(),
    "alert_feed_critical": O.alert_feed_sql(severity="critical", include_resolved=True),
    "alert_totals": O.alert_totals_sql(),
    "alert_durations": O.alert_durations_sql(),
    "forecast_linear": O.forecast_linear_sql(),
    "saturation": O.saturation_sql(),
    "queue_overlay": O.queue_overlay_sql(),
    "upsert_latest": O.upsert_sql(),
    "retention": O.retention_sql(),
    "stale_keys": O.stale_keys_sql(),
}
ORACLES["drift_history"] = O.drift_history_sql()
ORACLES["drift_incremental"] = O.drift_incremental_sql()
ORACLES["forecast_cached"] = O.forecast_cached_sql()
ORACLES["table_maintenance"] = O.table_maintenance_sql()
ORACLES["train_quarantine"] = O.train_quarantine_sql()
ORACLES["compare_models"] = O.compare_models_sql()
ORACLES["tick_assembly"] = O.tick_assembly_sql()
ORACLES["anomaly_baselines"] = O.anomaly_baselines_sql()
ORACLES["contributing_dims"] = O.contributing_dims_sql()
ORACLES["exposition_samples"] = O.exposition_samples_sql()
ORACLES["gpu_node_match"] = O.gpu_node_match_sql()
ORACLES["pod_usage"] = O.pod_usage_sql()
ORACLES["scrape_metrics"] = O.scrape_metrics_sql()
ORACLES["stream_rate"] = O.counter_rate_sql()
ORACLES["stream_bucket"] = O.stream_bucket_sql()
ORACLES["stream_ingest"] = O.scrape_metrics_sql()
ORACLES["drift_advice"] = O.drift_advice_sql()
ORACLES["saturation_advice"] = O.saturation_advice_sql()
