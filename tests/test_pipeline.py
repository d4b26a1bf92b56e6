"""The whole landing → bronze → silver pipeline on small landed fixtures."""

import json
import os

from inventa.streaming.silver_views import read_silver, register_views, run_pipeline

E3 = "05e9a617-0261-4cee-bb44-138d3ef5d965"


def land(root, entity, tenant, day, name, rows):
    d = f"{root}/{entity}/{tenant}/{day}"
    os.makedirs(d, exist_ok=True)
    with open(f"{d}/{name}", "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")


def test_pipeline(spark, tmp_root):
    L, lake = f"{tmp_root}/landing", f"{tmp_root}/lake"
    land(L, "entra_users", "t1", "2024-01-01", "entra_users_r1.jsonl", [
        {"id": "u1", "userPrincipalName": "A@x.com", "mail": " A@X.com ", "assignedLicenses": [{"skuId": E3}],
         "onPremisesExtensionAttributes": {"extensionAttribute1": "ext1"}},
        {"id": "u2", "userPrincipalName": "b@x.com", "mail": None, "assignedLicenses": []}])
    land(L, "entra_users", "t2", "2024-01-01", "entra_users_r1.jsonl", [{"id": "u1", "userPrincipalName": "c@y.com"}])
    land(L, "entra_groups", "t1", "2024-01-01", "entra_groups_r1.jsonl", [
        {"id": "g1", "groupTypes": ["Unified"], "mailEnabled": True, "securityEnabled": False,
         "resourceProvisioningOptions": ["Team"]},
        {"id": "g2", "groupTypes": [], "mailEnabled": True, "securityEnabled": True, "resourceProvisioningOptions": []}])
    land(L, "exo_mailboxes", "t1", "2024-01-01", "exo_mailboxes_r1.jsonl", [
        {"ExchangeGuid": "m1", "PrimarySmtpAddress": "A@x.com"}, {"ExchangeGuid": "m2", "PrimarySmtpAddress": "b@x.com"}])
    land(L, "exo_mailboxes", "t1", "2024-01-01/statistics", "chunk-000_r1.jsonl", [
        {"MailboxGuid": "m1", "ItemCount": "12", "TablesTotalSize": "1048576"}])
    land(L, "exo_mailboxes", "t1", "2024-01-01/permissions", "chunk-000_r1.jsonl", [
        {"exchangeGuid": "m1", "userPrincipalName": "A@x.com",
         "mailboxPermissions": [json.dumps({"trustee": "bob", "accessRights": ["FullAccess"], "isInherited": False,
                                            "deny": False}),
                                json.dumps({"trustee": "SELF", "accessRights": ["FullAccess"], "isInherited": False,
                                            "deny": False})],
         "sendAsPermissions": [], "sendOnBehalfTo": ["carol"]}])
    land(L, "spo_sites", "t1", "2024-01-01/permissions", "chunk-000_r1.jsonl", [
        {"siteUrl": "https://t1.sharepoint.com/sites/a", "sensitivityLabel": "General",
         "admins": [{"loginName": "i:0#.f|membership|adm@t1", "title": "Adm"}],
         "groups": [{"id": "1", "title": "Visitors", "members": [
             {"loginName": "c:0-.f|rolemanager|spo-grid-all-users/x", "title": "Everyone"},
             {"loginName": "i:0#.f|membership|guest#ext#@t1", "title": "Guest"}]}],
         "sharingLinks": [{"linkId": "l1", "scope": "anonymous", "itemPath": "/a"}],
         "documentLibraries": [{"title": "Docs", "itemCount": 3}]}])
    land(L, "entra_sign_in_logs", "t1", "2024-01-01", "entra_sign_in_logs_r1.jsonl", [
        {"id": "s1", "status": {"errorCode": 0, "failureReason": "ok"}, "location": {"city": "Oslo"}}])
    land(L, "entra_devices", "t1", "2024-01-01", "entra_devices_r1.jsonl", [{"id": "d1", "isManaged": True}])
    os.makedirs(f"{L}/_orchestrator/runs/2026-01-01", exist_ok=True)
    with open(f"{L}/_orchestrator/runs/2026-01-01/runs_r1.jsonl", "w") as f:
        f.write(json.dumps({"run_id": "r1", "status": "completed", "tenant_count": 2}) + "\n")

    bronze = ["entra_users", "entra_groups", "exo_mailboxes", "exo_mailbox_statistics", "exo_mailbox_permissions",
              "spo_site_permissions", "entra_sign_in_logs", "entra_devices", "orchestrator_runs", "teams_teams"]
    report = run_pipeline(spark, L, lake, bronze_names=bronze)
    assert report["bronze.entra_users"] == {"rows": 3, "passed": 3, "failed": 0}
    assert "bronze.teams_teams" not in report  # nothing landed: skipped, not failed

    users = {(r["tenant_key"], r["id"]): r for r in read_silver(spark, lake, "users").collect()}
    assert users[("t1", "u1")]["license_type"] == "E3"
    assert users[("t1", "u1")]["mail"] == "a@x.com"
    assert users[("t1", "u1")]["extension_attribute_1"] == "ext1"
    assert users[("t2", "u1")]["department"] is None
    groups = {r["id"]: (r["group_type"], r["is_teams_enabled"]) for r in read_silver(spark, lake, "groups").collect()}
    assert groups == {"g1": ("Microsoft 365", True), "g2": ("Mail-enabled Security", False)}
    mbx = {r["exchange_guid"]: r for r in read_silver(spark, lake, "mailboxes").collect()}
    assert mbx["m1"]["item_count"] == 12 and mbx["m1"]["total_item_size_bytes"] == 1048576
    assert mbx["m2"]["item_count"] is None
    entries = sorted((r["permission_type"], r["trustee"]) for r in read_silver(spark, lake, "exo_mailbox_permission_entries").collect())
    assert entries == [("MailboxPermission", "bob"), ("SendOnBehalf", "carol")]
    summ = read_silver(spark, lake, "exo_mailbox_permissions_summary").first()
    assert (summ["total_permission_count"], summ["has_full_access"], summ["has_send_on_behalf"]) == (2, True, True)
    site = read_silver(spark, lake, "spo_site_permissions_summary").first()
    assert (site["has_eeeu"], site["has_guests"], site["has_anonymous_links"], site["library_count"],
            site["sensitivity_label"]) == (True, True, True, 1, "General")
    principals = sorted((r["role"], r["group_title"]) for r in
                        read_silver(spark, lake, "spo_site_permission_principals").collect())
    assert principals == [("admin", None), ("member", "Visitors"), ("member", "Visitors")]
    links = read_silver(spark, lake, "spo_sharing_links").first()
    assert (links["link_id"], links["scope"], links["library"]) == ("l1", "anonymous", None)
    sign = read_silver(spark, lake, "sign_in_logs").first()
    assert (sign["error_code"], sign["location_city"], sign["device_browser"]) == (0, "Oslo", None)
    runs = read_silver(spark, lake, "orchestrator_runs").first()
    assert runs["tenant_count"] == 2 and "tenant_key" not in read_silver(spark, lake, "orchestrator_runs").columns

    # statistics for m2 land later: the stream does not re-emit m2, a rebuild does
    land(L, "exo_mailboxes", "t1", "2024-01-02/statistics", "chunk-000_r2.jsonl", [
        {"MailboxGuid": "m2", "ItemCount": "5", "TablesTotalSize": "2097152"}])
    run_pipeline(spark, L, lake, bronze_names=["exo_mailbox_statistics"], silver_names=[])
    from inventa.streaming.silver_views import rebuild
    from inventa.sources.landing import infer_schema
    from inventa.specs import BRONZE
    spec = BRONZE["exo_mailboxes"].with_schema(infer_schema(spark, L, "exo_mailboxes"))
    rebuild(spark, lake, "mailboxes", bronze_spec=spec)
    mbx = {r["exchange_guid"]: r["item_count"] for r in read_silver(spark, lake, "mailboxes").collect()}
    assert mbx == {"m1": 12, "m2": 5}

    # a second landing run updates one user; the other keys stay
    land(L, "entra_users", "t1", "2024-01-02", "entra_users_r2.jsonl", [{"id": "u1", "mail": "new@x.com"}])
    run_pipeline(spark, L, lake, bronze_names=["entra_users"], silver_names=["users"])
    users = {(r["tenant_key"], r["id"]): r["mail"] for r in read_silver(spark, lake, "users").collect()}
    assert users == {("t1", "u1"): "new@x.com", ("t1", "u2"): None, ("t2", "u1"): None}
    assert "users" in register_views(spark, lake, ["users"])
    assert spark.sql("SELECT count(*) FROM silver_users").first()[0] == 3


def test_wide_keys_keep_both_rows(spark, tmp_root):
    L, lake = f"{tmp_root}/landing", f"{tmp_root}/lake"
    land(L, "spo_sites", "t1", "2024-01-01/permissions", "chunk-000_r1.jsonl", [
        {"siteUrl": "https://t1/s", "admins": [],
         "groups": [{"id": "1", "title": "Owners", "members": [{"loginName": "bob"}]},
                    {"id": "2", "title": "Members", "members": [{"loginName": "bob"}]}]}])
    run_pipeline(spark, L, lake, bronze_names=["spo_site_permissions"], silver_names=["spo_site_permission_principals"])
    assert read_silver(spark, lake, "spo_site_permission_principals").count() == 1  # the reference's lossy key
    lake2 = f"{tmp_root}/lake2"
    run_pipeline(spark, L, lake2, bronze_names=["spo_site_permissions"], silver_names=["spo_site_permission_principals"],
                 wide_key=True)
    from inventa.streaming.silver import silver_table
    from inventa.streaming.silver_views import silver_spec
    t = silver_table(spark, f"{lake2}/silver", silver_spec("spo_site_permission_principals", wide_key=True))
    assert sorted(r["group_title"] for r in t.read().collect()) == ["Members", "Owners"]


def test_late_fields_and_broken_lines_are_kept(spark, tmp_root):
    L, lake = f"{tmp_root}/landing", f"{tmp_root}/lake"
    land(L, "entra_users", "t1", "2024-01-01", "entra_users_r1.jsonl", [{"id": "u1", "mail": "a@x"}])
    with open(f"{L}/entra_users/t1/2024-01-01/entra_users_r1.jsonl", "a") as f:
        f.write('{"id": "broken\n')
    run_pipeline(spark, L, lake, bronze_names=["entra_users"], silver_names=["users"])
    land(L, "entra_users", "t1", "2024-01-02", "entra_users_r2.jsonl", [
        {"id": "u2", "jobTitle": "Chief", "assignedLicenses": [{"skuId": E3}], "somethingNew": {"a": 1}}])
    run_pipeline(spark, L, lake, bronze_names=["entra_users"], silver_names=["users"])
    users = {r["id"]: r for r in read_silver(spark, lake, "users").collect()}
    assert set(users) == {"u1", "u2"} and users["u2"]["job_title"] == "Chief" and users["u2"]["license_type"] == "E3"
    rescued = sorted(r["_rescued_data"] for r in spark.read.parquet(f"{lake}/bronze/entra_users").collect() if r["_rescued_data"])
    assert rescued == ['{"_corrupt_record":"{\\"id\\": \\"broken"}', '{"somethingNew":"{\\"a\\":1}"}']


def test_optional_structs_survive(spark, tmp_root):
    L, lake = f"{tmp_root}/landing", f"{tmp_root}/lake"
    land(L, "entra_applications", "t1", "2024-01-01/proxy_config", "chunk-000_r1.jsonl", [
        {"applicationId": "a1", "id": "p1", "onPremisesPublishing": {"externalUrl": "https://e", "isSecureCookieEnabled": True}}])
    land(L, "entra_service_principals", "t1", "2024-01-01/sync_jobs", "chunk-000_r1.jsonl", [
        {"servicePrincipalId": "s1", "id": "j1", "schedule": {"state": "Active"}, "status": {"code": "Idle"}}])
    run_pipeline(spark, L, lake, bronze_names=["entra_app_proxy_config", "entra_provisioning_jobs"],
                 silver_names=["app_proxy_config", "provisioning_jobs"])
    app = read_silver(spark, lake, "app_proxy_config").first()
    assert (app["external_url"], app["is_secure_cookie_enabled"], app["external_auth_type"]) == ("https://e", True, None)
    job = read_silver(spark, lake, "provisioning_jobs").first()
    assert (json.loads(job["schedule"]), json.loads(job["status"])) == ({"state": "Active"}, {"code": "Idle"})


def test_stored_bucket_count_and_late_columns_of_a_table(spark, tmp_root):
    from pyspark.sql import functions as F

    from inventa.sources.tables import VersionedTable
    path = f"{tmp_root}/vt"
    rows = spark.range(200).select(F.col("id").alias("k"), F.lit(1).alias("s"))
    VersionedTable(spark, path, ["k"], [F.col("s")], buckets=16).upsert(rows)
    again = VersionedTable(spark, path, ["k"], [F.col("s")], buckets=8)
    again.upsert(rows.where("k < 20").withColumn("s", F.lit(2)).withColumn("late", F.lit("x")))
    got = again.read()
    assert got.count() == 200 and got.where("late = 'x'").count() == 20
