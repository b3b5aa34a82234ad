"""faultline: root-cause analytics over logs, metric series and call traces, written for Spark."""
