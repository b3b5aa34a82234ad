"""Fixed values. Results depend on them: metric profiles, scenario catalogue, stop words."""

# Metric profile = (mean, std, min, max) in normal operation.
PROFILES = {
    "request_count": (1200, 150, 200, 5000),
    "response_time_ms": (45, 8, 10, 500),
    "cache_hit_ratio": (0.85, 0.05, 0.0, 1.0),
    "traffic_mbps": (250, 40, 10, 2000),
    "error_rate": (0.02, 0.008, 0.0, 1.0),
    "connection_attempts": (800, 120, 50, 10000),
    "blocked_connections": (30, 10, 0, 5000),
    "allowed_traffic_mbps": (180, 30, 10, 1000),
    "bandwidth_mbps": (200, 35, 10, 2000),
    "request_rate": (500, 80, 20, 5000),
    "load_average": (1.5, 0.5, 0.1, 20.0),
    "connection_count": (150, 30, 5, 2000),
    "lb_utilization_pct": (45, 10, 0, 100),
    "connection_health_pct": (98, 1.5, 0, 100),
    "pod_count": (8, 2, 1, 50),
    "cpu_usage_pct": (35, 10, 1, 100),
    "memory_usage_pct": (45, 12, 5, 100),
    "pod_healthy_pct": (98, 2, 0, 100),
    "restart_count": (0.5, 0.8, 0, 50),
    "qps": (350, 60, 10, 3000),
    "transaction_count": (2000, 400, 100, 15000),
    "availability_pct": (99.5, 0.3, 80, 100),
    "query_response_ms": (15, 5, 1, 500),
    "active_sessions": (25, 8, 1, 500),
    "disk_io_mbps": (50, 15, 1, 500),
    "slow_query_count": (3, 2, 0, 200),
    "disk_usage_pct": (55, 10, 5, 100),
    "iops": (800, 150, 50, 10000),
    "latency_ms": (5, 2, 0.5, 200),
    "disk_error_count": (0.2, 0.5, 0, 100),
    "network_in_mbps": (120, 25, 5, 1000),
    "network_out_mbps": (100, 20, 5, 1000),
    "packet_loss_pct": (0.1, 0.05, 0.0, 100),
    "connection_errors": (2, 1.5, 0, 500),
    "process_count": (180, 30, 50, 1000),
    "network_io_mbps": (80, 20, 1, 500),
    "temperature_c": (55, 5, 25, 105),
    "fan_speed_rpm": (2500, 300, 800, 6000),
}

# Profile of an unknown metric, and its wider clip range after an anomaly was applied.
DEFAULT_PROFILE = (50, 10, 0, 100)
DEFAULT_ANOMALY_RANGE = (0, 99999)

# Layer key, layer name, its metrics.
LAYERS = (
    ("cdn", "CDN", ("request_count", "response_time_ms", "cache_hit_ratio", "traffic_mbps", "error_rate")),
    ("firewall", "Firewall", ("connection_attempts", "blocked_connections", "allowed_traffic_mbps", "error_rate", "bandwidth_mbps")),
    ("proxy", "Proxy", ("request_rate", "response_time_ms", "error_rate", "load_average", "connection_count")),
    ("kubernetes_ingress", "Kubernetes Ingress", ("request_rate", "response_time_ms", "error_rate", "lb_utilization_pct", "connection_health_pct")),
    ("kubernetes_deployments", "Kubernetes Deployments", ("pod_count", "cpu_usage_pct", "memory_usage_pct", "pod_healthy_pct", "restart_count")),
    ("application", "Application Layer", ("qps", "error_rate", "response_time_ms", "transaction_count", "availability_pct")),
    ("database", "Database", ("query_response_ms", "connection_count", "active_sessions", "disk_io_mbps", "cache_hit_ratio", "slow_query_count")),
    ("storage", "Storage", ("disk_usage_pct", "iops", "latency_ms", "disk_error_count")),
    ("network", "Network", ("network_in_mbps", "network_out_mbps", "packet_loss_pct", "latency_ms", "connection_errors")),
    ("linux_vm", "Linux VM", ("cpu_usage_pct", "memory_usage_pct", "disk_io_mbps", "load_average", "process_count", "network_io_mbps")),
    ("linux_host", "Linux Host (Physical Machine)", ("cpu_usage_pct", "memory_usage_pct", "disk_usage_pct", "temperature_c", "fan_speed_rpm")),
)

# Id, layer, name, root cause, category, severity, anomaly type, detection metrics, actions.
SCENARIOS = (
    ("CDN_001", "cdn", "Sudden Traffic Spike", "Potential DDoS attack or temporary spike", "network", "critical", "spike",
     ("request_count", "traffic_mbps", "error_rate"),
     ("Apply IP restrictions on firewall", "Trigger rate limiting script on CDN")),
    ("CDN_002", "cdn", "Response Time Increase", "CDN performance degradation, server overload", "software", "high", "gradual_rise",
     ("response_time_ms", "cache_hit_ratio", "error_rate"),
     ("Clear CDN cache", "Redirect traffic to alternative servers")),
    ("FW_001", "firewall", "Increased Blocked Connections", "Potential attack or misconfiguration", "network", "high", "spike",
     ("blocked_connections", "connection_attempts"),
     ("Temporarily block related IP/port", "Update firewall rules")),
    ("FW_002", "firewall", "High Bandwidth Usage", "Excessive traffic or potential data exfiltration", "network", "high", "sustained_high",
     ("bandwidth_mbps", "connection_attempts"),
     ("Trigger bandwidth limit control script", "Analyze network traffic")),
    ("PRX_001", "proxy", "Error Rate Surge", "Proxy configuration issue or excessive load", "software", "high", "gradual_rise",
     ("error_rate", "load_average", "connection_count"),
     ("Restart proxy server", "Trigger connection limit script")),
    ("PRX_002", "proxy", "Response Latency", "Proxy resource exhaustion", "resource", "medium", "gradual_rise",
     ("response_time_ms", "request_rate"),
     ("Clear proxy cache", "Temporarily block heavy-request IPs")),
    ("K8I_001", "kubernetes_ingress", "High Error Rate", "Connection issues or configuration error", "config", "high", "spike",
     ("error_rate", "connection_health_pct", "lb_utilization_pct"),
     ("Reconfigure Ingress", "Redirect traffic")),
    ("K8I_002", "kubernetes_ingress", "Unbalanced Traffic Distribution", "Misconfiguration or load balancing issue", "config", "medium", "oscillation",
     ("request_rate", "lb_utilization_pct", "connection_health_pct"),
     ("Optimize traffic balancing settings", "Ensure equal distribution across pods")),
    ("K8D_001", "kubernetes_deployments", "Pod Restart Count Increase", "Resource insufficiency or application error", "resource", "high", "spike",
     ("restart_count", "cpu_usage_pct", "pod_healthy_pct"),
     ("Restart pods", "Increase resource allocation")),
    ("K8D_002", "kubernetes_deployments", "CPU Usage Increase", "High CPU demand or memory leak", "resource", "high", "sustained_high",
     ("cpu_usage_pct", "memory_usage_pct", "pod_healthy_pct"),
     ("Auto-scale pod count (horizontal scaling)", "Update CPU limits")),
    ("APP_001", "application", "Processing Time Increase", "Database latency or API error", "software", "high", "gradual_rise",
     ("response_time_ms", "error_rate", "transaction_count"),
     ("Restart database connection", "Review API queries")),
    ("APP_002", "application", "Error Rate Increase", "Application or API connection error", "software", "critical", "spike",
     ("error_rate", "transaction_count", "qps"),
     ("Limit API connection count", "Restart application")),
    ("DB_001", "database", "Slow Query Increase", "Intense query traffic or insufficient optimization", "software", "high", "gradual_rise",
     ("slow_query_count", "disk_io_mbps", "query_response_ms"),
     ("Run slow query optimization script", "Apply query prioritization")),
    ("DB_002", "database", "Connection Count Increase", "High user traffic or DDoS attack", "network", "critical", "spike",
     ("connection_count", "active_sessions", "query_response_ms"),
     ("Apply connection limiting", "Temporarily block heavy-request IPs")),
    ("STR_001", "storage", "High Disk Usage", "Insufficient disk space or log file accumulation", "resource", "high", "gradual_rise",
     ("disk_usage_pct", "iops", "latency_ms"),
     ("Start disk cleanup", "Delete old log files")),
    ("STR_002", "storage", "Latency Increase", "Disk I/O bottleneck or disk failure", "hardware", "high", "spike",
     ("latency_ms", "iops", "disk_error_count"),
     ("Run I/O optimization script", "Check disk health status")),
    ("NET_001", "network", "Packet Loss Increase", "Network device issue or connectivity problem", "network", "high", "spike",
     ("packet_loss_pct", "connection_errors", "network_in_mbps"),
     ("Renew connections", "Restart faulty network devices")),
    ("NET_002", "network", "Excessive Latency", "Network congestion or configuration error", "network", "medium", "sustained_high",
     ("latency_ms", "network_out_mbps", "connection_errors"),
     ("Run traffic optimization script", "Analyze network traffic")),
    ("VM_001", "linux_vm", "CPU Usage Surge", "Resource exhaustion or abnormal process increase", "resource", "high", "sustained_high",
     ("cpu_usage_pct", "load_average", "process_count"),
     ("Terminate unnecessary processes", "Optimize CPU limits")),
    ("VM_002", "linux_vm", "Memory Exhaustion", "Memory leak or high memory demand", "resource", "critical", "gradual_rise",
     ("memory_usage_pct", "disk_io_mbps", "load_average"),
     ("Run memory cleanup script", "Monitor and optimize swap usage")),
    ("HOST_001", "linux_host", "CPU Temperature Increase", "Hardware overheating or cooling problem", "hardware", "critical", "gradual_rise",
     ("temperature_c", "fan_speed_rpm", "cpu_usage_pct"),
     ("Increase fan speed", "Terminate unnecessary processes")),
    ("HOST_002", "linux_host", "Disk Error Count Increase", "Disk failure or wear-out", "hardware", "critical", "step_increase",
     ("disk_usage_pct", "temperature_c"),
     ("Check disk health", "Backup data and send alerts")),
)

# What a scenario does to metrics: metric, kind of change, range, pattern.
EFFECTS = {
    "CDN_001": (("request_count", "multiplier", 3.0, 10.0, "sudden_spike"), ("traffic_mbps", "multiplier", 2.5, 8.0, "sudden_spike"), ("error_rate", "additive", 0.05, 0.25, "gradual_rise")),
    "CDN_002": (("response_time_ms", "multiplier", 2.0, 5.0, "gradual_rise"), ("cache_hit_ratio", "multiplier", 0.3, 0.6, "gradual_drop"), ("error_rate", "additive", 0.02, 0.1, "gradual_rise")),
    "FW_001": (("blocked_connections", "multiplier", 3.0, 15.0, "sudden_spike"), ("connection_attempts", "multiplier", 2.0, 8.0, "sudden_spike")),
    "FW_002": (("bandwidth_mbps", "multiplier", 2.5, 6.0, "sustained_high"), ("connection_attempts", "multiplier", 1.5, 4.0, "gradual_rise")),
    "PRX_001": (("error_rate", "additive", 0.05, 0.3, "gradual_rise"), ("load_average", "multiplier", 1.5, 3.0, "gradual_rise"), ("connection_count", "multiplier", 2.0, 5.0, "sustained_high")),
    "PRX_002": (("response_time_ms", "multiplier", 2.0, 6.0, "gradual_rise"), ("request_rate", "multiplier", 1.5, 3.0, "sustained_high")),
    "K8I_001": (("error_rate", "additive", 0.05, 0.25, "sudden_spike"), ("connection_health_pct", "multiplier", 0.4, 0.7, "gradual_drop"), ("lb_utilization_pct", "additive", 15.0, 40.0, "sustained_high")),
    "K8I_002": (("lb_utilization_pct", "additive", 20.0, 45.0, "oscillation"), ("request_rate", "multiplier", 1.2, 2.5, "oscillation")),
    "K8D_001": (("restart_count", "additive", 3.0, 15.0, "step_increase"), ("cpu_usage_pct", "additive", 15.0, 35.0, "gradual_rise"), ("pod_healthy_pct", "multiplier", 0.5, 0.8, "gradual_drop")),
    "K8D_002": (("cpu_usage_pct", "additive", 20.0, 40.0, "sustained_high"), ("memory_usage_pct", "additive", 10.0, 30.0, "gradual_rise")),
    "APP_001": (("response_time_ms", "multiplier", 2.0, 5.0, "gradual_rise"), ("error_rate", "additive", 0.02, 0.1, "gradual_rise"), ("transaction_count", "multiplier", 0.5, 0.8, "gradual_drop")),
    "APP_002": (("error_rate", "additive", 0.1, 0.4, "sudden_spike"), ("qps", "multiplier", 0.3, 0.6, "sudden_drop"), ("availability_pct", "multiplier", 0.7, 0.9, "gradual_drop")),
    "DB_001": (("slow_query_count", "multiplier", 3.0, 10.0, "gradual_rise"), ("disk_io_mbps", "multiplier", 1.5, 3.0, "sustained_high"), ("query_response_ms", "multiplier", 2.0, 6.0, "gradual_rise")),
    "DB_002": (("connection_count", "multiplier", 3.0, 8.0, "sudden_spike"), ("active_sessions", "multiplier", 2.5, 6.0, "sudden_spike"), ("query_response_ms", "multiplier", 1.5, 4.0, "gradual_rise")),
    "STR_001": (("disk_usage_pct", "additive", 15.0, 30.0, "gradual_rise"), ("iops", "multiplier", 1.5, 3.0, "sustained_high"), ("latency_ms", "multiplier", 1.3, 2.5, "gradual_rise")),
    "STR_002": (("latency_ms", "multiplier", 3.0, 8.0, "sudden_spike"), ("iops", "multiplier", 0.3, 0.6, "sudden_drop"), ("disk_error_count", "additive", 5.0, 20.0, "step_increase")),
    "NET_001": (("packet_loss_pct", "additive", 2.0, 15.0, "sudden_spike"), ("connection_errors", "multiplier", 3.0, 10.0, "sudden_spike"), ("network_in_mbps", "multiplier", 0.4, 0.7, "gradual_drop")),
    "NET_002": (("latency_ms", "multiplier", 2.0, 5.0, "sustained_high"), ("network_out_mbps", "multiplier", 0.5, 0.8, "gradual_drop"), ("connection_errors", "additive", 5.0, 25.0, "gradual_rise")),
    "VM_001": (("cpu_usage_pct", "additive", 25.0, 45.0, "sustained_high"), ("load_average", "multiplier", 2.0, 5.0, "sustained_high"), ("process_count", "additive", 50.0, 200.0, "gradual_rise")),
    "VM_002": (("memory_usage_pct", "additive", 20.0, 40.0, "gradual_rise"), ("disk_io_mbps", "multiplier", 1.5, 3.0, "gradual_rise"), ("load_average", "multiplier", 1.5, 3.0, "gradual_rise")),
    "HOST_001": (("temperature_c", "additive", 10.0, 25.0, "gradual_rise"), ("fan_speed_rpm", "multiplier", 1.3, 1.8, "gradual_rise"), ("cpu_usage_pct", "additive", 15.0, 35.0, "sustained_high")),
    "HOST_002": (("disk_usage_pct", "additive", 5.0, 15.0, "step_increase"), ("temperature_c", "additive", 3.0, 8.0, "gradual_rise")),
}

# Built-in prompts in our own words; placeholders and the doubled braces are part of the format.
PROMPTS = {
    "anomaly_classification": (
        "You are a site reliability engineer who judges system log sessions.",
        "Decide whether this log session is normal or anomalous.\n\n## Session\n{session_text}\n\n"
        "Weigh error and warning lines, the order of events and events that should be there but are not.\n\n"
        'Answer as JSON:\n{{"classification": "NORMAL" or "ANOMALY", "confidence": 0.0 to 1.0, '
        '"reasoning": "...", "key_indicators": ["..."]}}',
    ),
    "root_cause_analysis": (
        "You find the root cause of failures in distributed systems from their logs.",
        "Find the root cause behind this anomalous session.\n\n## Session\n{session_text}\n\n"
        "## Templates\n{template_info}\n\nName the first failure, how it spread, and what to do about it.\n\n"
        'Answer as JSON:\n{{"root_cause": "...", "root_cause_category": '
        '"hardware|software|config|network|resource|unknown", "affected_components": ["..."], '
        '"error_chain": [{{"event": "E001", "description": "..."}}], "severity": "critical|high|medium|low", '
        '"remediation": ["..."], "confidence": 0.0 to 1.0}}',
    ),
    "comparative_analysis": (
        "You compare log sessions and say what sets a failing one apart.",
        "Compare the two sessions.\n\n## Normal\n{normal_session}\n\n## Anomalous\n{anomaly_session}\n\n"
        'Answer as JSON:\n{{"differences": [{{"aspect": "...", "normal": "...", "anomaly": "..."}}], '
        '"key_discriminators": ["..."], "missing_events": ["..."], "extra_events": ["..."]}}',
    ),
}

# The English stop words Spark ships.
STOP_WORDS = tuple(
    (
        "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
        "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
        "was were be been being have has had having do does did doing a an the and but if or because as until while "
        "of at by for with about against between into through during before after above below to from up down in out "
        "on off over under again further then once here there when where why how all any both each few more most "
        "other some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll "
        "she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've "
        "you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't "
        "shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's "
        "who's why's would"
    ).split()
)
