"""Explicit schemas of every file and table; nothing is inferred."""

QUERIES = "query_id string, query string, type string"
OCR_TEXTS = "id string, texto_referencia string"
OCR_PREDICTIONS = "id string, texto_ocr string"
SAMPLE = "id string, grupo string, legibilidad string, fondo string, forma string, path string, filename string"
POOL = "query_id string, img_id string, relevante_0_1 string"
BLIND_KEY = "modelo_ciego string, modelo_real string"

SEGMENTS = "eval_id string, image_path string, `group` int, filename string, segment_id string, segment_type string, segment_text string"

# Relational catalogue, column for column.
CATALOG = {
    "collections": "id long, name string, slug string, small_description string, description string, start_date date, end_date date, "
                   "is_public boolean, is_active boolean, created_by long, updated_by long, created_at timestamp_ntz, updated_at timestamp_ntz",
    "collections_notes": "id long, image_id long, author_id long, body string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "collection_images": "collection_id long, image_id long, sort_order int, added_by long, added_at timestamp_ntz",
    "collection_labels": "collection_id long, label_id long",
    "image_labels": "image_id long, label_id long, assigned_by long, assigned_at timestamp_ntz",
    "image_notes": "id long, image_id long, author_id long, body string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "labels": "id long, name string, slug string, description string, color string, created_by long, is_active boolean, "
              "created_at timestamp_ntz, updated_at timestamp_ntz",
    "parameters": "session int, session_close int, time_label int, time_index int",
    "roles": "id short, code string, name string, description string",
    "users": "id long, email string, password_hash string, full_name string, profile string, description string, is_active boolean, "
             "last_login_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz",
    "user_roles": "user_id long, role_id short, assigned_at timestamp_ntz",
    "user_activity_logs": "user_id long, user_email string, action string, method string, path string, ip_address string, user_agent string, details string",
}

# Keys the audits check: primary or unique columns, and (columns -> table.column) references.
KEYS = {
    "collections": [["id"], ["slug"]], "collections_notes": [["id"]], "collection_images": [["collection_id", "image_id"]],
    "collection_labels": [["collection_id", "label_id"]], "image_labels": [["image_id", "label_id"]], "image_notes": [["id"]],
    "labels": [["id"], ["slug"]], "roles": [["id"], ["code"]], "users": [["id"], ["email"]], "user_roles": [["user_id", "role_id"]],
}
REFERENCES = [
    ("collections", "created_by", "users", "id"), ("collections", "updated_by", "users", "id"), ("collections_notes", "author_id", "users", "id"),
    ("collection_images", "collection_id", "collections", "id"), ("collection_images", "added_by", "users", "id"),
    ("collection_labels", "collection_id", "collections", "id"), ("collection_labels", "label_id", "labels", "id"),
    ("image_labels", "label_id", "labels", "id"), ("image_labels", "assigned_by", "users", "id"), ("image_notes", "author_id", "users", "id"),
    ("labels", "created_by", "users", "id"), ("user_roles", "user_id", "users", "id"), ("user_roles", "role_id", "roles", "id"),
]
