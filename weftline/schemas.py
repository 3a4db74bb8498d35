"""Schemas of the tables, as DDL; files are read with them and never by inference."""

RESPONSES = "url string, final_url string, status int, content_type string, body binary, headers map<string,string>"
FRONTIER = "url string, depth int, seq bigint"
VISITED = FRONTIER
FAILED = "url string, depth int, seq bigint, error string"
URL_MAP = "url string, local_path string"
BLOBS = "sha256 string, canonical string, copies bigint"
LOG = "seq bigint, action string, url string, local_path string, error string, timestamp double"
ROBOTS = "host string, agent string, part int, seq int, allow boolean, prefix string"
MANIFEST = "project_name string, created_at double, version string, last_saved_at double"
SETTINGS = (
    "start_url string, output_dir string, project_name string, same_host_only boolean, include_subdomains boolean, max_depth int, concurrency int, "
    "request_delay double, respect_robots boolean, use_renderer boolean, lazy_scroll boolean, fetch_external_assets boolean, asset_filter string, "
    "excluded_extensions array<string>, excluded_paths array<string>, user_agent string, cookie_file string, timeout int, wait_after_load double, "
    "strip_tracking_params boolean, tracking_params array<string>"
)
