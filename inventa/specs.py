"""Entity registry: the bronze tables (what lands where) and the silver tables
(which key they are upserted by).  Data only; the builders live in
``inventa.streaming``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class BronzeSpec:
    name: str                       # bronze table name
    entity: str                     # landing folder
    detail_type: str | None = None  # Phase-2 sub folder, None = Phase 1
    file_pattern: str = "*.{jsonl,jsonl.gz}"
    ddl: str | None = None          # declared schema; None = inferred (S5)
    source_system: str = "graph_api"
    expect_tenant: bool = True
    tenant_from_dir: bool = True
    rescue: bool = True             # keep fields the schema lacks, and broken lines
    levels: int = 2                 # folder levels below the entity (tenant, date)

    @property
    def schema(self) -> T.StructType:
        if self.ddl is None:
            raise ValueError(f"{self.name}: schema is inferred, freeze it first")
        return T._parse_datatype_string(self.ddl)

    def with_schema(self, schema: T.StructType) -> "BronzeSpec":
        return BronzeSpec(self.name, self.entity, self.detail_type, self.file_pattern,
                          _ddl_of(schema), self.source_system, self.expect_tenant,
                          self.tenant_from_dir, self.rescue, self.levels)


def _ddl_of(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _strings(*names: str, **typed: str) -> str:
    cols = [f"`{n}` string" for n in names] + [f"`{n}` {t}" for n, t in typed.items()]
    return ", ".join(cols)


# Declared landing schemas (field names as the collectors write them).
ENTRA_DEVICES = _strings(
    "id", "deviceId", "displayName", "operatingSystem", "operatingSystemVersion", "trustType") + ", " + \
    "isManaged boolean, isCompliant boolean, accountEnabled boolean, " + _strings(
    "approximateLastSignInDateTime", "createdDateTime", "model", "manufacturer", "profileType",
    "deviceCategory", "enrollmentProfileName") + ", onPremisesSyncEnabled boolean, " + _strings(
    "onPremisesLastSyncDateTime", "onPremisesSecurityIdentifier", "mdmAppId", "registrationDateTime")
INTUNE_MANAGED_DEVICES = _strings(
    "id", "deviceName", "managedDeviceOwnerType", "enrolledDateTime", "lastSyncDateTime",
    "operatingSystem", "complianceState", "jailBroken", "managementAgent", "osVersion") + \
    ", azureADRegistered boolean, " + _strings(
    "deviceEnrollmentType", "emailAddress", "azureADDeviceId", "deviceRegistrationState") + \
    ", isEncrypted boolean, " + _strings(
    "userPrincipalName", "model", "manufacturer", "serialNumber", "userId", "userDisplayName",
    "totalStorageSpaceInBytes", "freeStorageSpaceInBytes", "managedDeviceName",
    "partnerReportedThreatState") + ", autopilotEnrolled boolean, isSupervised boolean"
MDE_DEVICES = _strings(
    "id", "computerDnsName", "firstSeen", "lastSeen", "osPlatform", "osArchitecture", "version",
    "osBuild", "lastIpAddress", "lastExternalIpAddress", "healthStatus", "onboardingStatus",
    "riskScore", "exposureLevel", "aadDeviceId") + ", machineTags array<string>, " + _strings(
    "rbacGroupName", "rbacGroupId", "deviceValue")
DELEGATED_GRANTS = _strings("id", "clientId", "consentType", "principalId", "resourceId", "scope")
DIRECTORY_LINKS = _strings("displayName", "userPrincipalName", "mail", "@odata.type")
EXO_GROUP_MEMBERS = _strings("groupIdentity", "groupObjectId", "groupType", "memberName",
                             "memberObjectId", "memberType", "primarySmtp")
TEAMS_CHANNELS = _strings("teamId", "id", "displayName", "description", "membershipType",
                          "createdDateTime", "webUrl", "email") + ", isArchived boolean"
TEAMS_CHANNEL_MEMBERS = _strings("teamId", "channelId", "id", "displayName", "email") + \
    ", roles array<string>, `@odata.type` string"
TEAMS_INSTALLED_APPS = _strings("teamId", "appId", "displayName", "teamsAppId", "version", "publishingState")
TEAMS_CHANNEL_TABS = _strings("teamId", "channelId", "id", "displayName", "webUrl", "appDisplayName", "teamsAppId")
ROLE_ASSIGNMENTS = _strings("servicePrincipalId", "id", "appRoleId", "principalDisplayName", "principalId",
                            "principalType", "resourceDisplayName", "resourceId", "createdDateTime")
CLAIMS_POLICIES = _strings("servicePrincipalId", "id", "displayName") + \
    ", definition array<string>, isOrganizationDefault boolean"
APP_PROXY = _strings("applicationId", "id", "displayName") + """, onPremisesPublishing struct<externalUrl: string,
    internalUrl: string, externalAuthenticationType: string, isTranslateHostHeaderEnabled: boolean,
    isTranslateLinksInBodyEnabled: boolean, isHttpOnlyCookieEnabled: boolean, isSecureCookieEnabled: boolean,
    isPersistentCookieEnabled: boolean>"""
PERM_CLASSIFICATIONS = _strings("servicePrincipalId", "id", "permissionId", "permissionName", "classification")
# the two structs vary by service: kept as their JSON text
PROVISIONING_JOBS = _strings("servicePrincipalId", "id", "templateId", "schedule", "status")
ORCHESTRATOR_RUN = _strings("run_id", "job_name", "trigger_type", "triggered_by", "status",
                            "started_at", "completed_at") + \
    ", tenant_count int, entity_count int, resolved_tenants array<string>, resolved_entities array<string>"
ORCHESTRATOR_TASK = _strings("run_id", "job_name", "tenant_key", "container_type", "aca_execution_name") + \
    ", entities array<string>, " + _strings("status", "started_at", "completed_at", "error_message")


BRONZE: dict[str, BronzeSpec] = {s.name: s for s in [
    BronzeSpec("entra_users", "entra_users"),
    BronzeSpec("entra_groups", "entra_groups"),
    BronzeSpec("entra_contacts", "entra_contacts"),
    BronzeSpec("exo_mailboxes", "exo_mailboxes", source_system="exchange_online"),
    BronzeSpec("exo_contacts", "exo_contacts", source_system="exchange_online"),
    BronzeSpec("exo_mail_users", "exo_mail_users", source_system="exchange_online"),
    BronzeSpec("exo_distribution_groups", "exo_distribution_groups", source_system="exchange_online"),
    BronzeSpec("exo_unified_groups", "exo_unified_groups", source_system="exchange_online"),
    BronzeSpec("spo_sites", "spo_sites", file_pattern="spo_sites_*.jsonl", source_system="sharepoint"),
    BronzeSpec("spo_site_usage", "spo_sites", detail_type="usage", source_system="sharepoint"),
    BronzeSpec("teams_teams", "teams_teams", file_pattern="teams_teams_*.jsonl"),
    BronzeSpec("teams_team_settings", "teams_teams", detail_type="settings"),
    BronzeSpec("entra_devices", "entra_devices", ddl=ENTRA_DEVICES),
    BronzeSpec("intune_managed_devices", "intune_managed_devices", ddl=INTUNE_MANAGED_DEVICES),
    BronzeSpec("mde_devices", "mde_devices", ddl=MDE_DEVICES, source_system="defender"),
    BronzeSpec("entra_applications", "entra_applications"),
    BronzeSpec("entra_service_principals", "entra_service_principals"),
    BronzeSpec("entra_delegated_permission_grants", "entra_delegated_permission_grants", ddl=DELEGATED_GRANTS),
    BronzeSpec("entra_group_members", "entra_groups", "members", ddl="`groupId` string, `id` string, " + DIRECTORY_LINKS),
    BronzeSpec("entra_group_owners", "entra_groups", "owners", ddl="`groupId` string, `id` string, " + DIRECTORY_LINKS),
    BronzeSpec("exo_group_members", "exo_distribution_groups", "members", ddl=EXO_GROUP_MEMBERS,
               source_system="exchange_online"),
    BronzeSpec("teams_channels", "teams_teams", "channels", ddl=TEAMS_CHANNELS),
    BronzeSpec("entra_sp_assignments", "entra_service_principals", "assignments", ddl=ROLE_ASSIGNMENTS),
    BronzeSpec("entra_sp_owners", "entra_service_principals", "owners",
               ddl="`servicePrincipalId` string, `id` string, " + DIRECTORY_LINKS),
    BronzeSpec("entra_app_owners", "entra_applications", "owners",
               ddl="`applicationId` string, `id` string, " + DIRECTORY_LINKS),
    BronzeSpec("exo_mailbox_statistics", "exo_mailboxes", "statistics", source_system="exchange_online"),
    BronzeSpec("spo_site_permissions", "spo_sites", "permissions", source_system="sharepoint"),
    BronzeSpec("exo_mailbox_permissions", "exo_mailboxes", "permissions", source_system="exchange_online"),
    BronzeSpec("teams_channel_members", "teams_teams", "members", ddl=TEAMS_CHANNEL_MEMBERS),
    BronzeSpec("teams_installed_apps", "teams_teams", "apps", ddl=TEAMS_INSTALLED_APPS),
    BronzeSpec("teams_channel_tabs", "teams_teams", "tabs", ddl=TEAMS_CHANNEL_TABS),
    BronzeSpec("entra_application_permission_grants", "entra_service_principals", "app_role_assignments",
               ddl=ROLE_ASSIGNMENTS),
    BronzeSpec("entra_sp_claims_mapping_policies", "entra_service_principals", "claims_policies",
               ddl=CLAIMS_POLICIES),
    BronzeSpec("entra_delegated_permission_classifications", "entra_service_principals",
               "perm_classifications", ddl=PERM_CLASSIFICATIONS),
    BronzeSpec("entra_sign_in_logs", "entra_sign_in_logs"),
    BronzeSpec("entra_app_proxy_config", "entra_applications", "proxy_config", ddl=APP_PROXY),
    BronzeSpec("entra_provisioning_jobs", "entra_service_principals", "sync_jobs", ddl=PROVISIONING_JOBS),
    # run history lands under _orchestrator/{runs|tasks}/{date}/: no tenant folder (see README)
    BronzeSpec("orchestrator_runs", "_orchestrator/runs", detail_type=None, ddl=ORCHESTRATOR_RUN,
               source_system="orchestrator", expect_tenant=False, tenant_from_dir=False, levels=1),
    BronzeSpec("orchestrator_tasks", "_orchestrator/tasks", detail_type=None, ddl=ORCHESTRATOR_TASK,
               source_system="orchestrator", expect_tenant=False, tenant_from_dir=False, levels=1),
]}


@dataclass(frozen=True)
class SilverSpec:
    name: str
    bronze: str
    keys: tuple[str, ...]                    # source fields after the tenant
    with_tenant: bool = True
    renames: dict[str, str] = field(default_factory=dict)  # overrides of the snake_case rule


SILVER: dict[str, SilverSpec] = {s.name: s for s in [
    SilverSpec("users", "entra_users", ("id",)),
    SilverSpec("groups", "entra_groups", ("id",)),
    SilverSpec("mailboxes", "exo_mailboxes", ("ExchangeGuid",)),
    SilverSpec("exo_contacts", "exo_contacts", ("ExternalDirectoryObjectId",)),
    SilverSpec("exo_mail_users", "exo_mail_users", ("ExternalDirectoryObjectId",)),
    SilverSpec("distribution_groups", "exo_distribution_groups", ("ExternalDirectoryObjectId",)),
    SilverSpec("unified_groups", "exo_unified_groups", ("ExternalDirectoryObjectId",)),
    SilverSpec("entra_contacts", "entra_contacts", ("id",)),
    SilverSpec("spo_sites", "spo_sites", ("id",)),
    SilverSpec("entra_group_members", "entra_group_members", ("groupId", "id")),
    SilverSpec("entra_group_owners", "entra_group_owners", ("groupId", "id")),
    SilverSpec("exo_group_members", "exo_group_members", ("groupObjectId", "memberObjectId")),
    SilverSpec("spo_site_permissions_summary", "spo_site_permissions", ("siteUrl",)),
    SilverSpec("spo_site_permission_principals", "spo_site_permissions", ("siteUrl", "source", "loginName")),
    SilverSpec("spo_sharing_links", "spo_site_permissions", ("siteUrl", "linkId")),
    SilverSpec("exo_mailbox_permissions_summary", "exo_mailbox_permissions", ("exchangeGuid",)),
    SilverSpec("exo_mailbox_permission_entries", "exo_mailbox_permissions", ("exchangeGuid", "kind", "trustee")),
    SilverSpec("teams", "teams_team_settings", ("id",)),
    SilverSpec("teams_channels", "teams_channels", ("teamId", "id")),
    SilverSpec("teams_channel_members", "teams_channel_members", ("teamId", "channelId", "id")),
    SilverSpec("teams_installed_apps", "teams_installed_apps", ("teamId", "appId")),
    SilverSpec("teams_channel_tabs", "teams_channel_tabs", ("teamId", "channelId", "id")),
    SilverSpec("devices", "entra_devices", ("id",)),
    SilverSpec("intune_managed_devices", "intune_managed_devices", ("id",)),
    SilverSpec("mde_devices", "mde_devices", ("id",)),
    SilverSpec("applications", "entra_applications", ("id",)),
    SilverSpec("service_principals", "entra_service_principals", ("id",)),
    SilverSpec("delegated_permission_grants", "entra_delegated_permission_grants", ("id",)),
    SilverSpec("sp_assignments", "entra_sp_assignments", ("servicePrincipalId", "id")),
    SilverSpec("sp_owners", "entra_sp_owners", ("servicePrincipalId", "id")),
    SilverSpec("app_owners", "entra_app_owners", ("applicationId", "id")),
    SilverSpec("application_permission_grants", "entra_application_permission_grants", ("servicePrincipalId", "id")),
    SilverSpec("sp_claims_mapping_policies", "entra_sp_claims_mapping_policies", ("servicePrincipalId", "id")),
    SilverSpec("delegated_permission_classifications", "entra_delegated_permission_classifications",
               ("servicePrincipalId", "id")),
    SilverSpec("sign_in_logs", "entra_sign_in_logs", ("id",)),
    SilverSpec("app_proxy_config", "entra_app_proxy_config", ("applicationId",)),
    SilverSpec("provisioning_jobs", "entra_provisioning_jobs", ("servicePrincipalId", "id")),
    SilverSpec("orchestrator_runs", "orchestrator_runs", ("run_id",), with_tenant=False),
    SilverSpec("orchestrator_tasks", "orchestrator_tasks", ("run_id", "tenant_key", "container_type"),
               with_tenant=False),
]}


_CAMEL_1 = re.compile(r"(.)([A-Z][a-z]+)")
_CAMEL_2 = re.compile(r"([a-z0-9])([A-Z])")


def snake_case(name: str) -> str:
    """P1 naming rule: ``userPrincipalName`` → ``user_principal_name``,
    ``@odata.type`` → ``odata_type``, ``ExchangeGuid`` → ``exchange_guid``."""
    cleaned = re.sub(r"[^0-9A-Za-z_]+", "_", name).strip("_")
    s = _CAMEL_2.sub(r"\1_\2", _CAMEL_1.sub(r"\1_\2", cleaned))
    return re.sub(r"_+", "_", s).lower()
