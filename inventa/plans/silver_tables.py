"""Silver tables compared column by column: records derived from the provided
tables land as JSON lines, go through bronze and are read back from silver.

The oracles state every column of a table, those that nothing landed for as
typed NULL.  ``_source_file`` and ``_dlt_ingested_at`` are left out: they hold
a path and a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inventa.plans.registry import register
from inventa.session import scratch_path, table
from inventa.sources.landing import write_landing
from inventa.streaming.silver import SEQUENCE
from inventa.streaming.silver_views import read_silver, run_pipeline

E3 = "05e9a617-0261-4cee-bb44-138d3ef5d965"
E5 = "06ebc4ee-1bb5-47dd-8120-11324bc54e06"


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _land(rows: DataFrame, base: str, entity: str, detail_type: str | None = None) -> None:
    rows = rows.withColumn("_t", F.lit("t1")).withColumn("_d", F.lit("2024-01-01"))
    write_landing(rows, f"{base}/landing", entity, "_t", "_d", "r1", detail_type=detail_type,
                  chunk_prefix="chunk" if detail_type else None)


def _silver(spark: SparkSession, base: str, name: str) -> DataFrame:
    return read_silver(spark, f"{base}/lake", name).drop(*SEQUENCE)


def _nulls(*names: str) -> str:
    return ", ".join(f"CAST(NULL AS VARCHAR) AS {n}" for n in names)


@register("silver_users_table", sql=f"""
SELECT 't1_u' || c_custkey AS _scd_key, 't1' AS tenant_key, 'u' || c_custkey AS id, c_name AS user_principal_name,
  lower(c_name) || '@x.example' AS mail, c_name AS display_name, c_mktsegment AS job_title, 'n' || c_nationkey AS country,
  c_custkey % 2 = 0 AS account_enabled, '2024-01-01' AS created_at, '2024-02-01' AS last_password_change,
  '2024-03-01' AS external_user_state_changed_at, '2024-04-01' AS on_premises_last_sync,
  CASE WHEN c_custkey % 4 IN (0, 1) THEN 'E5' WHEN c_custkey % 4 = 2 THEN 'E3' END AS license_type,
  CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS extension_attribute_1,
  CASE WHEN c_custkey % 3 > 0 THEN 'x' || c_nationkey END AS extension_attribute_15,
  {_nulls('given_name', 'surname', 'mail_nickname', 'department', 'office_location', 'city', 'state', 'company_name',
          'street_address', 'postal_code', 'usage_location', 'preferred_language', 'preferred_data_location',
          'business_phones', 'mobile_phone', 'fax_number', 'other_mails', 'employee_id', 'employee_type',
          'employee_hire_date', 'user_type', 'creation_type', 'password_policies', 'security_identifier',
          'external_user_state', 'identities', 'proxy_addresses', 'on_premises_sync_enabled', 'on_premises_domain_name',
          'on_premises_distinguished_name', 'on_premises_immutable_id', 'on_premises_sam_account_name',
          'on_premises_security_identifier', 'on_premises_user_principal_name', 'on_premises_provisioning_errors',
          'service_provisioning_errors', *(f'extension_attribute_{i}' for i in range(2, 15)))}
FROM customer
""")
def silver_users_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the users table, from customers."""
    base, key = scratch_path(spark, "silver_users"), F.col("c_custkey")
    sku = F.when(key % 4 == 0, F.array(F.lit(E5))).when(key % 4 == 1, F.array(F.lit(E3), F.lit(E5))).when(
        key % 4 == 2, F.array(F.lit("other"), F.lit(E3))).otherwise(F.array().cast("array<string>"))
    ext = F.struct(F.col("c_mktsegment").alias("extensionAttribute1"),
                   F.concat(F.lit("x"), _text("c_nationkey")).alias("extensionAttribute15"))
    _land(table(spark, sf_dir, "customer").select(
        F.concat(F.lit("u"), key.cast("string")).alias("id"), F.col("c_name").alias("userPrincipalName"),
        F.concat(F.lit("  "), F.upper("c_name"), F.lit("@X.Example ")).alias("mail"), F.col("c_name").alias("displayName"),
        F.col("c_mktsegment").alias("jobTitle"), F.concat(F.lit("n"), _text("c_nationkey")).alias("country"),
        (key % 2 == 0).alias("accountEnabled"), F.lit("2024-01-01").alias("createdDateTime"),
        F.lit("2024-02-01").alias("lastPasswordChangeDateTime"), F.lit("2024-03-01").alias("externalUserStateChangeDateTime"),
        F.lit("2024-04-01").alias("onPremisesLastSyncDateTime"),
        F.transform(sku, lambda s: F.struct(s.alias("skuId"))).alias("assignedLicenses"),
        F.when(key % 3 > 0, ext).alias("onPremisesExtensionAttributes")), base, "entra_users")
    run_pipeline(spark, f"{base}/landing", f"{base}/lake", bronze_names=["entra_users"], silver_names=["users"])
    return _silver(spark, base, "users")


_CUSTOM = [*(f"custom_attribute_{i}" for i in range(1, 16)), *(f"extension_custom_attribute_{i}" for i in range(1, 6))]


@register("silver_mailboxes_table", sql=f"""
SELECT 't1_m' || p_partkey AS _scd_key, 't1' AS tenant_key, 'm' || p_partkey AS exchange_guid,
  lower(p_brand) || '@x.example' AS primary_smtp_address, p_name AS display_name, p_size > 25 AS hidden_from_address_lists,
  p_size > 10 AS message_copy_for_sent_as, p_type AS custom_attribute_15,
  CASE WHEN p_partkey % 2 = 0 THEN p_size END AS item_count,
  CASE WHEN p_partkey % 2 = 0 THEN p_size * 1024 END AS total_item_size_bytes,
  CASE WHEN p_partkey % 2 = 0 AND p_size <> 7 THEN 3 END AS deleted_item_count,
  CASE WHEN p_partkey % 2 = 0 THEN '2024-05-01' END AS last_logon_time,
  CASE WHEN p_partkey % 2 = 0 THEN p_name END AS last_logon_user,
  {_nulls('external_directory_object_id', 'user_principal_name', 'alias', 'email_addresses', 'database', 'when_created',
          'when_mailbox_created', 'is_mailbox_enabled', 'is_resource', 'resource_type', 'resource_capacity',
          'room_mailbox_account_enabled', 'forwarding_address', 'forwarding_smtp_address',
          'deliver_to_mailbox_and_forward', 'grant_send_on_behalf_to', 'message_copy_for_send_on_behalf',
          'archive_status', 'archive_state', 'archive_guid', 'archive_name', 'auto_expanding_archive',
          'litigation_hold_enabled', 'litigation_hold_date', 'litigation_hold_owner', 'litigation_hold_duration',
          'in_place_holds', 'compliance_tag_hold_applied', 'delay_hold_applied', 'retention_policy',
          'retention_hold_enabled', 'retain_deleted_items_for', 'single_item_recovery_enabled', 'issue_warning_quota',
          'prohibit_send_quota', 'prohibit_send_receive_quota', 'use_database_quota_defaults', 'max_receive_size',
          'max_send_size', 'recipient_limits', 'mailbox_move_status', 'mailbox_move_batch_name',
          'mailbox_move_remote_host_name', 'mailbox_move_flags', 'is_inactive_mailbox', 'is_soft_deleted_by_disable',
          'is_soft_deleted_by_remove', 'when_soft_deleted', 'is_archive_mailbox', *(c for c in _CUSTOM if c != 'custom_attribute_15'))}
FROM part
""")
def silver_mailboxes_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the mailboxes table; half of the parts have
    statistics, whose numbers arrive as text."""
    base, p = scratch_path(spark, "silver_mailboxes"), table(spark, sf_dir, "part")
    guid = F.concat(F.lit("m"), _text("p_partkey"))
    _land(p.select(guid.alias("ExchangeGuid"), F.concat(F.lit(" "), F.upper("p_brand"), F.lit("@x.example")).alias("PrimarySmtpAddress"),
                   F.col("p_name").alias("DisplayName"), (F.col("p_size") > 25).alias("HiddenFromAddressListsEnabled"),
                   (F.col("p_size") > 10).alias("MessageCopyForSentAsEnabled"), F.col("p_type").alias("CustomAttribute15")),
          base, "exo_mailboxes")
    _land(p.where("p_partkey % 2 = 0").select(
        guid.alias("MailboxGuid"), _text("p_size").alias("ItemCount"), (F.col("p_size") * 1024).cast("string").alias("TablesTotalSize"),
        F.when(F.col("p_size") == 7, "unknown").otherwise("3").alias("DeletedItemCount"), F.lit("2024-05-01").alias("LastLogonTime"),
        F.col("p_name").alias("LastLoggedOnUserAccount")), base, "exo_mailboxes", "statistics")
    run_pipeline(spark, f"{base}/landing", f"{base}/lake", bronze_names=["exo_mailboxes", "exo_mailbox_statistics"],
                 silver_names=["mailboxes"])
    return _silver(spark, base, "mailboxes")


@register("silver_site_principals_table", sql="""
WITH s AS (SELECT *, 'https://x/' || s_suppkey AS url FROM supplier)
SELECT 't1_' || url || '_admin_adm' || s_suppkey AS _scd_key, 't1' AS tenant_key, url AS site_url, 'admin' AS role,
  CAST(NULL AS VARCHAR) AS group_title, 'adm' || s_suppkey AS login_name, s_name AS title, 'a@x' AS email,
  false AS is_eeeu, CAST(NULL AS BOOLEAN) AS is_guest FROM s
UNION ALL
SELECT 't1_' || url || '_member_all', 't1', url, 'member', 'Visitors', 'all', 'Everyone', NULL, true, false FROM s WHERE s_suppkey % 2 = 0
UNION ALL
SELECT 't1_' || url || '_member_g' || s_suppkey, 't1', url, 'member', 'Owners', 'g' || s_suppkey, NULL, NULL, NULL, true FROM s WHERE s_suppkey % 2 = 0
""")
def silver_site_principals_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the site principals table, two array levels."""
    base, key = scratch_path(spark, "silver_principals"), F.col("s_suppkey")

    def person(login: Column, title: Column, email: Column, eeeu: Column, guest: Column) -> Column:
        return F.struct(login.alias("loginName"), title.alias("title"), email.alias("email"), eeeu.cast("boolean").alias("isEEEU"),
                        guest.cast("boolean").alias("isGuest"))

    none = F.lit(None).cast("string")
    admin = person(F.concat(F.lit("adm"), _text("s_suppkey")), F.col("s_name"), F.lit("a@x"), F.lit(False), F.lit(None))
    all_ = person(F.lit("all"), F.lit("Everyone"), none, F.lit(True), F.lit(False))
    guest = person(F.concat(F.lit("g"), _text("s_suppkey")), none, none, F.lit(None), F.lit(True))
    groups = F.when(key % 2 == 0, F.array(F.struct(F.lit("1").alias("id"), F.lit("Visitors").alias("title"), F.array(all_).alias("members")),
                                          F.struct(F.lit("2").alias("id"), F.lit("Owners").alias("title"), F.array(guest).alias("members"))))
    _land(table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("https://x/"), _text("s_suppkey")).alias("siteUrl"), F.array(admin).alias("admins"), groups.alias("groups")),
        base, "spo_sites", "permissions")
    run_pipeline(spark, f"{base}/landing", f"{base}/lake", bronze_names=["spo_site_permissions"],
                 silver_names=["spo_site_permission_principals"])
    return _silver(spark, base, "spo_site_permission_principals")


@register("silver_mailbox_entries_table", sql="""
WITH s AS (SELECT *, 'm' || s_suppkey AS g, 'U' || s_suppkey AS upn FROM supplier)
SELECT 't1_' || g || '_mailbox_bob' AS _scd_key, 't1' AS tenant_key, g AS exchange_guid, upn AS user_principal_name,
  's@x' AS primary_smtp_address, 'UserMailbox' AS recipient_type_details, 'bob' AS trustee,
  'FullAccess,ReadPermission' AS access_rights, 'MailboxPermission' AS permission_type, false AS is_inherited, true AS deny FROM s
UNION ALL
SELECT 't1_' || g || '_sendas', 't1', g, upn, 's@x', 'UserMailbox', NULL, 'SendAs', 'SendAs', true, NULL FROM s WHERE s_suppkey % 3 = 0
UNION ALL
SELECT 't1_' || g || '_sendonbehalf_SELF', 't1', g, upn, 's@x', 'UserMailbox', 'SELF', 'SendOnBehalf', 'SendOnBehalf', false, NULL
FROM s WHERE s_suppkey % 2 = 0
""")
def silver_mailbox_entries_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the permission entries table; the mailbox's
    own account is dropped from two kinds, an unknown trustee stays."""
    base, key = scratch_path(spark, "silver_entries"), F.col("s_suppkey")

    def grant(trustee: Column, rights: list[str], inherited: bool, deny: bool | None = None) -> Column:
        fields = [trustee.cast("string").alias("trustee"), F.array(*map(F.lit, rights)).alias("accessRights"),
                  F.lit(inherited).alias("isInherited")]
        return F.struct(*fields, *([] if deny is None else [F.lit(deny).alias("deny")]))

    own = F.when(key % 2 == 0, "SELF").otherwise("nt authority\\self")
    _land(table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("m"), _text("s_suppkey")).alias("exchangeGuid"), F.concat(F.lit("U"), _text("s_suppkey")).alias("userPrincipalName"),
        F.lit("s@x").alias("primarySmtpAddress"), F.lit("UserMailbox").alias("recipientTypeDetails"),
        F.array(grant(F.lit("bob"), ["FullAccess", "ReadPermission"], False, True), grant(own, ["FullAccess"], False, False))
        .alias("mailboxPermissions"),
        F.when(key % 3 == 0, F.array(grant(F.lit(None), ["SendAs"], True))).otherwise(F.array(grant(own, ["SendAs"], False)))
        .alias("sendAsPermissions"),
        F.when(key % 2 == 0, F.array(F.lit("SELF"))).alias("sendOnBehalfTo")), base, "exo_mailboxes", "permissions")
    run_pipeline(spark, f"{base}/landing", f"{base}/lake", bronze_names=["exo_mailbox_permissions"],
                 silver_names=["exo_mailbox_permission_entries"])
    return _silver(spark, base, "exo_mailbox_permission_entries")


@register("silver_sign_ins_table", sql=f"""
SELECT 't1_' || event_id AS _scd_key, 't1' AS tenant_key, CAST(event_id AS VARCHAR) AS id, '2024-01-01' AS created_at,
  event_type AS app_display_name, 'u' || user_id AS user_id, event_id % 3 AS error_code,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'denied' END AS failure_reason, 'Oslo' AS location_city, 'NO' AS location_country,
  CASE WHEN event_id % 2 = 0 THEN 'Linux' END AS device_os, event_type AS risk_event_types,
  {_nulls('app_id', 'ip_address', 'client_app_used', 'conditional_access_status', 'is_interactive', 'resource_display_name',
          'resource_id', 'risk_detail', 'risk_level_aggregated', 'risk_level_during_sign_in', 'risk_state',
          'user_display_name', 'user_principal_name', 'location_state', 'device_browser', 'device_id')}
FROM events WHERE event_id IS NOT NULL
""")
def silver_sign_ins_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the sign-in table, three structs flattened."""
    base, key = scratch_path(spark, "silver_sign_ins"), F.col("event_id")
    _land(table(spark, sf_dir, "events").select(
        _text("event_id").alias("id"), F.lit("2024-01-01").alias("createdDateTime"), F.col("event_type").alias("appDisplayName"),
        F.concat(F.lit("u"), _text("user_id")).alias("userId"), F.col("event_type").alias("riskEventTypes_v2"),
        F.struct((key % 3).alias("errorCode"), F.when(key % 3 != 0, "denied").alias("failureReason")).alias("status"),
        F.struct(F.lit("Oslo").alias("city"), F.lit("NO").alias("countryOrRegion")).alias("location"),
        F.when(key % 2 == 0, F.struct(F.lit("Linux").alias("operatingSystem"))).alias("deviceDetail")), base, "entra_sign_in_logs")
    run_pipeline(spark, f"{base}/landing", f"{base}/lake", bronze_names=["entra_sign_in_logs"], silver_names=["sign_in_logs"])
    return _silver(spark, base, "sign_in_logs")
