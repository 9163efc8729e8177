"""Rule texts, analyzers and knowledge records: the small dimension tables of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palisade.session import dimension

# --- Fixed values: analyzers as (name, languages, frameworks, priority). ---

ANALYZERS = (
    ("python-ast-security", ["python"], [], 100),
    ("fastapi-authorization-security", ["python"], ["fastapi"], 91),
    ("python-configuration-security", ["python"], [], 90),
    ("fastapi-authentication-security", ["python"], ["fastapi"], 90),
    ("fastapi-endpoint-security", ["python"], ["fastapi"], 80),
)

# --- Fixed values: source rules as (rule_id, analyzer, title, description, category, severity, confidence,
#     remediation, cwe_id, owasp_reference). ---

SOURCE_RULES = (
    ("CODE-001", "python-ast-security", "Unsafe eval usage",
     "The eval function dynamically executes a Python expression and may allow arbitrary code execution when influenced by untrusted input.",
     "code-injection", "critical", "high",
     "Remove eval and use an explicit parser, allowlist, or ast.literal_eval for trusted literal structures.",
     "CWE-95", "API8:2023"),
    ("CODE-002", "python-ast-security", "Unsafe exec usage",
     "The exec function dynamically executes Python code and can permit arbitrary code execution.",
     "code-injection", "critical", "high",
     "Remove exec and replace dynamic execution with explicitly implemented application logic.",
     "CWE-95", "API8:2023"),
    ("CMD-001", "python-ast-security", "Subprocess shell execution enabled",
     "A subprocess call enables shell execution. Untrusted command content may result in operating-system command injection.",
     "command-injection", "critical", "high",
     "Set shell=False, pass the command as an argument list, and validate every externally controlled argument.",
     "CWE-78", "API8:2023"),
    ("CMD-002", "python-ast-security", "Unsafe os.system usage",
     "os.system executes a command through the operating system shell and may enable command injection.",
     "command-injection", "critical", "high",
     "Replace os.system with subprocess.run using an argument list, shell=False, strict validation, and a timeout.",
     "CWE-78", "API8:2023"),
    ("DESER-001", "python-ast-security", "Unsafe pickle deserialization",
     "Python pickle deserialization may execute attacker-controlled code when the serialized data is untrusted.",
     "unsafe-deserialization", "critical", "high",
     "Do not deserialize untrusted pickle data. Use a safe format such as JSON with strict schema validation.",
     "CWE-502", "API8:2023"),
    ("DESER-002", "python-ast-security", "Unsafe YAML loading",
     "yaml.load may construct arbitrary Python objects when used without a safe loader.",
     "unsafe-deserialization", "high", "high",
     "Use yaml.safe_load or explicitly configure SafeLoader.",
     "CWE-502", "API8:2023"),
    ("SQL-001", "python-ast-security", "Potential SQL injection",
     "A dynamically constructed SQL statement is passed to a database execution method.",
     "sql-injection", "critical", "medium",
     "Use parameterized queries or ORM query builders. Never concatenate, format, or interpolate untrusted values into SQL statements.",
     "CWE-89", "API8:2023"),
    ("SSRF-001", "python-ast-security", "Potential server-side request forgery",
     "A request-controlled or dynamically constructed URL is passed to an outbound HTTP client. An attacker may be able to reach internal services, cloud metadata endpoints, or unintended hosts.",
     "server-side-request-forgery", "high", "medium",
     "Resolve outbound destinations from a strict scheme and hostname allowlist, reject private and link-local addresses after DNS resolution, disable unsafe redirects, and never forward caller credentials to an untrusted destination.",
     "CWE-918", "API7:2023"),
    ("HTTP-001", "python-ast-security", "Outbound HTTP request has no timeout",
     "An outbound HTTP request does not define a timeout. A slow or unresponsive upstream can retain workers and exhaust service resources.",
     "unrestricted-resource-consumption", "medium", "high",
     "Set explicit connection and read timeouts, bound retries with backoff, and enforce an overall request deadline.",
     "CWE-400", "API4:2023"),
    ("HTTP-002", "python-ast-security", "TLS certificate verification disabled",
     "An outbound HTTPS client explicitly disables certificate verification, allowing a network attacker to impersonate the upstream service.",
     "unsafe-api-consumption", "high", "high",
     "Keep certificate verification enabled and configure a trusted CA bundle when the upstream uses a private certificate authority.",
     "CWE-295", "API10:2023"),
    ("SECRET-001", "python-configuration-security", "Hardcoded secret detected",
     "A sensitive credential or secret appears to be hardcoded directly in Python source code.",
     "secrets-management", "critical", "high",
     "Remove the secret from source control, rotate the credential immediately, and load it from a protected environment variable or secrets-management service.",
     "CWE-798", "API8:2023"),
    ("SECRET-002", "python-configuration-security", "Weak application secret detected",
     "A security-sensitive secret appears too short, predictable, or low entropy for cryptographic use.",
     "secrets-management", "high", "high",
     "Generate a cryptographically random secret of at least 32 bytes and store it outside the source repository.",
     "CWE-330", "API2:2023"),
    ("CONFIG-001", "python-configuration-security", "Debug mode enabled",
     "Debug mode is enabled in application configuration. Production debug output may expose sensitive internal details or interactive debugging capabilities.",
     "security-misconfiguration", "high", "high",
     "Disable debug mode in production and control diagnostic logging through environment-specific configuration.",
     "CWE-489", "API8:2023"),
    ("TLS-001", "python-configuration-security", "TLS certificate verification disabled",
     "An outbound HTTP request explicitly disables TLS certificate verification, allowing man-in-the-middle attacks.",
     "transport-security", "high", "high",
     "Enable certificate verification. Configure the correct trusted CA bundle instead of using verify=False.",
     "CWE-295", "API8:2023"),
    ("JWT-001", "python-configuration-security", "Insecure JWT algorithm configured",
     "JWT handling permits the none algorithm, which can allow unsigned tokens to be accepted.",
     "authentication", "critical", "high",
     "Reject unsigned JWTs and enforce an explicit allowlist of strong algorithms such as RS256 or ES256.",
     "CWE-347", "API2:2023"),
    ("JWT-002", "python-configuration-security", "JWT signature verification disabled",
     "JWT decoding disables signature verification, allowing attackers to forge authentication tokens.",
     "authentication", "critical", "high",
     "Enable JWT signature verification and validate issuer, audience, expiry, and the expected signing algorithm.",
     "CWE-347", "API2:2023"),
    ("CORS-001", "python-configuration-security", "Overly permissive CORS configuration",
     "The application allows requests from every origin. This may expose authenticated API responses to untrusted websites.",
     "security-misconfiguration", "high", "high",
     "Replace wildcard origins with an explicit allowlist of trusted application origins.",
     "CWE-942", "API8:2023"),
    ("CORS-002", "python-configuration-security", "Wildcard CORS with credentials enabled",
     "CORS is configured with wildcard origins while credentials are enabled, creating an unsafe and potentially invalid cross-origin security policy.",
     "security-misconfiguration", "critical", "high",
     "Use an explicit trusted-origin allowlist whenever cookies or authorization credentials are accepted.",
     "CWE-942", "API8:2023"),
    ("FASTAPI-AUTH-001", "fastapi-endpoint-security", "Sensitive FastAPI endpoint lacks authentication",
     "A security-sensitive FastAPI endpoint does not declare an authentication or authorization dependency.",
     "authentication", "high", "medium",
     "Protect the endpoint using a FastAPI dependency such as Depends(get_current_user), Security(...), or an equivalent authenticated principal dependency.",
     "CWE-306", "API2:2023"),
    ("FASTAPI-AUTH-002", "fastapi-endpoint-security", "Destructive endpoint lacks authorization",
     "A DELETE endpoint or destructive operation does not declare an authentication or authorization dependency.",
     "authorization", "critical", "high",
     "Require authentication and enforce object-level or role-based authorization before performing the destructive operation.",
     "CWE-862", "API1:2023"),
    ("FASTAPI-FILE-001", "fastapi-endpoint-security", "File upload lacks visible validation",
     "A FastAPI upload endpoint accepts UploadFile or File input without visible file type or size validation.",
     "file-upload", "high", "medium",
     "Validate the uploaded file extension, MIME type, actual file signature, and maximum permitted size before storage or processing. Generate server-side filenames and store uploads outside executable directories.",
     "CWE-434", "API8:2023"),
    ("FASTAPI-ERROR-001", "fastapi-endpoint-security", "Internal exception exposed to API client",
     "The endpoint appears to expose raw exception text through an HTTP response or HTTPException detail.",
     "information-disclosure", "medium", "high",
     "Log internal exception details server-side and return a stable, non-sensitive error message and correlation identifier to the client.",
     "CWE-209", "API8:2023"),
    ("FASTAPI-REDIRECT-001", "fastapi-endpoint-security", "Potential unvalidated redirect",
     "A redirect response appears to use a request-controlled value directly as the destination URL.",
     "input-validation", "medium", "medium",
     "Allow redirects only to approved relative paths or validate the destination against a strict server-side allowlist.",
     "CWE-601", "API10:2023"),
    ("FASTAPI-PROPERTY-001", "fastapi-endpoint-security", "Request model is unpacked into a data model",
     "The endpoint passes every request-model property into another constructor or update operation. Sensitive fields may become client-controlled even when they were not intended to be writable.",
     "property-authorization", "high", "medium",
     "Define a dedicated allowlisted input schema and map permitted fields explicitly. Never accept ownership, role, privilege, approval, balance, or tenant fields from an unrestricted payload.",
     "CWE-915", "API3:2023"),
    ("FASTAPI-RESOURCE-001", "fastapi-endpoint-security", "Collection endpoint has no visible pagination limit",
     "A collection-style GET endpoint does not expose or enforce a visible page, cursor, offset, or result limit. Large responses can consume excessive database, memory, network, and worker resources.",
     "resource-consumption", "medium", "medium",
     "Require bounded pagination, enforce a server-side maximum page size, constrain database queries, and test requests at the maximum allowed boundary.",
     "CWE-400", "API4:2023"),
    ("FASTAPI-FLOW-001", "fastapi-endpoint-security", "Sensitive business flow lacks visible abuse controls",
     "A sensitive business action does not declare a visible rate-limit, throttle, quota, challenge, or idempotency control. Automated abuse may exhaust inventory, trigger repeated transactions, or attack account workflows.",
     "business-flow-abuse", "high", "medium",
     "Apply identity- and resource-aware throttling, quotas, idempotency keys where appropriate, bot defenses for anonymous flows, and security monitoring for repeated failures or high-volume activity.",
     "CWE-799", "API6:2023"),
    ("FASTAPI-INVENTORY-001", "fastapi-endpoint-security", "Deprecated API endpoint remains exposed",
     "The route is marked deprecated but remains part of the deployed API surface. Older endpoints frequently miss controls added to current versions and increase the inventory that must be monitored.",
     "api-inventory", "low", "high",
     "Define and publish a retirement date, monitor remaining consumers, apply the same security controls as the current API, and remove the route after the migration window.",
     "CWE-1059", "API9:2023"),
    ("FASTAPI-AUTH-004", "fastapi-authentication-security", "JWT decoded without audience validation",
     "A JWT token is decoded without validating its intended audience. A token issued for another service may therefore be accepted by this API.",
     "authentication", "high", "medium",
     "Provide the expected audience when decoding the JWT and require the aud claim.",
     "CWE-287", "API2:2023"),
    ("FASTAPI-AUTH-005", "fastapi-authentication-security", "JWT decoded without issuer validation",
     "A JWT token is decoded without validating the trusted issuer.",
     "authentication", "high", "medium",
     "Provide the expected issuer when decoding the JWT and require the iss claim.",
     "CWE-287", "API2:2023"),
    ("FASTAPI-AUTH-006", "fastapi-authentication-security", "JWT signature verification disabled",
     "JWT decoding explicitly disables signature verification, allowing forged tokens to be accepted.",
     "authentication", "critical", "high",
     "Never disable JWT signature verification. Restrict accepted algorithms and validate the token using the correct signing key.",
     "CWE-347", "API2:2023"),
    ("FASTAPI-AUTH-007", "fastapi-authentication-security", "Anonymous administrative endpoint",
     "An administrative FastAPI endpoint does not declare a visible authentication or authorization dependency.",
     "authorization", "critical", "high",
     "Require an authenticated principal and enforce an administrator permission or role dependency before executing this endpoint.",
     "CWE-862", "API5:2023"),
    ("FASTAPI-AUTH-010", "fastapi-authentication-security", "Privilege assignment from request-controlled input",
     "A role, permission, administrator flag, or privilege field appears to be assigned directly from request-controlled input.",
     "authorization", "critical", "high",
     "Do not accept privileged account fields from normal request payloads. Assign roles and permissions only through a dedicated administrator-authorized workflow.",
     "CWE-269", "API5:2023"),
    ("FASTAPI-AUTH-003", "fastapi-authorization-security", "Potential broken object-level authorization",
     "The endpoint accesses an object using a request path identifier without a visible ownership or object-level authorization check.",
     "authorization", "critical", "medium",
     "Verify that the authenticated principal owns the requested object or has explicit permission to access it before returning it.",
     "CWE-639", "API1:2023"),
    ("FASTAPI-AUTH-008", "fastapi-authorization-security", "Authorization decision uses request-controlled privilege",
     "A role, permission, administrator flag, or privilege value from request-controlled input is used in an authorization decision.",
     "authorization", "high", "high",
     "Make authorization decisions using the authenticated principal and trusted server-side roles or permissions.",
     "CWE-807", "API5:2023"),
    ("FASTAPI-AUTH-009", "fastapi-authorization-security", "Missing ownership validation before object modification",
     "The endpoint updates or deletes an object selected using a request identifier without a visible ownership or authorization check.",
     "authorization", "critical", "medium",
     "Validate ownership or explicit authorization before updating or deleting the object.",
     "CWE-862", "API1:2023"),
)

# --- Fixed values: endpoint rules, one row per outcome, as (outcome, rule_id, title, description, category,
#     severity, confidence, remediation, owasp_reference, cwe_id). ---

ENDPOINT_RULES = (
    ("open_read", "AUTH-001", "Unauthenticated Read Endpoint",
     "The read endpoint does not declare an authentication requirement.",
     "authentication", "info", "medium",
     "Confirm that the endpoint is intentionally public. Otherwise, require a verified authentication dependency before returning data.",
     "API2:2023", "CWE-306"),
    ("open_write", "AUTH-001", "Authentication Missing",
     "The endpoint performs a state-changing operation without a discovered authentication requirement.",
     "authentication", "high", "high",
     "Require an authentication dependency, such as Depends(get_current_user), Security(...), HTTPBearer, OAuth2, or an API-key security dependency.",
     "API2:2023", "CWE-306"),
    ("unscoped_read", "AUTH-002", "Authorization Missing",
     "The endpoint requires authentication but no authorization rule, permission or scope was detected.",
     "authorization", "medium", "high",
     "Enforce role, permission or scope validation before processing the request.",
     "API5:2023", "CWE-862"),
    ("unscoped_write", "AUTH-002", "Authorization Missing",
     "The endpoint requires authentication but no authorization rule, permission or scope was detected.",
     "authorization", "high", "high",
     "Enforce role, permission or scope validation before processing the request.",
     "API5:2023", "CWE-862"),
    ("unvalidated", "VAL-001", "Input Validation Missing",
     "The endpoint accepts client-supplied input through body, form, or file parameters without detectable schema or type constraints.",
     "input_validation", "medium", "medium",
     "Validate request data with typed Pydantic models, constrained fields, Annotated validators, explicit length and range limits, allowlists, and custom validation for business rules.",
     "API8:2023", "CWE-20"),
    ("upload", "FILE-001", "Potentially Insecure File Upload",
     "The endpoint accepts uploaded files, but no detectable validation for file size, extension, MIME type, filename, or storage destination was discovered.",
     "file_upload", "high", "medium",
     "Allow only approved file extensions and MIME types, enforce a maximum file size, generate server-side filenames, store uploads outside executable web paths, and scan untrusted content before processing it.",
     "API8:2023", "CWE-434"),
)

# --- Fixed values: knowledge records as (rule_id, title, category, description, remediation, owasp, cwe, references). ---

KNOWLEDGE = (
    ("AUTH-001", "Missing Authentication", "Authentication", "Endpoint does not require authentication.",
     "Require authenticated users before allowing access.", ["API2:2023"], ["CWE-306"],
     ["https://owasp.org/API-Security/"]),
    ("AUTH-002", "Missing Authorization", "Authorization", "Endpoint lacks authorization checks.",
     "Enforce role or permission validation.", ["API5:2023"], ["CWE-285"], ["https://owasp.org/API-Security/"]),
    ("VAL-001", "Input Validation", "Validation", "Input validation is missing or insufficient.",
     "Validate and sanitize all incoming data.", ["API8:2023"], ["CWE-20"], ["https://owasp.org/API-Security/"]),
    ("FILE-001", "Unsafe File Upload", "File Upload", "Uploaded files are not sufficiently validated.",
     "Restrict file types, verify content and scan uploads.", ["API8:2023"], ["CWE-434"],
     ["https://owasp.org/API-Security/"]),
)

# --- Fixed values: OWASP API Top 10 of 2023 as (id, title, description). ---

OWASP_CATEGORIES = (
    ("API1:2023", "Broken Object Level Authorization", "Object-level authorization is not properly enforced."),
    ("API2:2023", "Broken Authentication", "Authentication weaknesses allow attackers to compromise identities."),
    ("API3:2023", "Broken Object Property Level Authorization", "Unauthorized access to sensitive object properties."),
    ("API4:2023", "Unrestricted Resource Consumption", "Missing limits can lead to denial-of-service conditions."),
    ("API5:2023", "Broken Function Level Authorization", "Functions are exposed without proper authorization."),
    ("API6:2023", "Unrestricted Access to Sensitive Business Flows",
     "Business workflows can be abused without sufficient controls."),
    ("API7:2023", "Server Side Request Forgery",
     "The API can be abused to make unintended server-side requests."),
    ("API8:2023", "Security Misconfiguration", "Incorrect configuration exposes the API to attack."),
    ("API9:2023", "Improper Inventory Management", "Deprecated or unmanaged API versions increase attack surface."),
    ("API10:2023", "Unsafe Consumption of APIs", "Trusting external APIs without validation introduces risk."),
)

_KNOWLEDGE_SCHEMA = (
    "rule_id string, title string, category string, description string, remediation string, "
    "owasp_api_categories array<string>, cwe_ids array<string>, capec_ids array<string>, "
    "references array<string>, cvss_vector string, cvss_score double, compliance map<string, array<string>>"
)


def analyzers(spark: SparkSession) -> DataFrame:
    """Analyzer dimension with its running order: priority first, then name, both descending."""
    ranked = sorted(ANALYZERS, key=lambda a: (a[3], a[0]), reverse=True)
    rows = [(*a, position) for position, a in enumerate(ranked)]
    return dimension(
        spark, rows, "analyzer string, languages array<string>, frameworks array<string>, priority int, analyzer_ord int"
    )


def source_rules(spark: SparkSession) -> DataFrame:
    columns = (
        "rule_id string, analyzer string, title string, description string, category string, severity string, "
        "confidence string, remediation string, cwe_id string, owasp_reference string"
    )
    return dimension(spark, list(SOURCE_RULES), columns)


def endpoint_rules(spark: SparkSession) -> DataFrame:
    columns = (
        "outcome string, rule_id string, title string, description string, category string, severity string, "
        "confidence string, remediation string, owasp_reference string, cwe_id string"
    )
    return dimension(spark, list(ENDPOINT_RULES), columns)


def knowledge(spark: SparkSession) -> DataFrame:
    rows = [
        (rule, title, category, text, fix, owasp, cwe, [], refs, None, None, {})
        for rule, title, category, text, fix, owasp, cwe, refs in KNOWLEDGE
    ]
    return dimension(spark, rows, _KNOWLEDGE_SCHEMA)


def owasp_categories(spark: SparkSession) -> DataFrame:
    return dimension(spark, list(OWASP_CATEGORIES), "owasp string, title string, description string")


def duplicate_rule_ids(dimension: DataFrame) -> DataFrame:
    """Rule ids registered more than once (the registries refuse them)."""
    return dimension.groupBy("rule_id").count().filter("count > 1")
