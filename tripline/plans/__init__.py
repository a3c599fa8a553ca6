"""The detections: functions from source DataFrames to a result DataFrame."""

from tripline.plans.cloud_keys import delegation_with_key_origin, key_creation_burst, plaintext_key_files
from tripline.plans.delegation import inactive_delegations, novel_api_calls
from tripline.plans.drive import immediate_encrypt, staged_encrypt
from tripline.plans.endpoint import (
    consent_prompt_disabled,
    elevated_com_children,
    hta_children,
    hta_files,
    hta_network,
    hta_target,
    webdav_retrieval_hosts,
    webdav_script_execution,
)
from tripline.plans.object_store import foreign_kms_encryption, object_deletion_burst, short_lifecycle

__all__ = [
    "consent_prompt_disabled",
    "delegation_with_key_origin",
    "elevated_com_children",
    "foreign_kms_encryption",
    "hta_children",
    "hta_files",
    "hta_network",
    "hta_target",
    "immediate_encrypt",
    "inactive_delegations",
    "key_creation_burst",
    "novel_api_calls",
    "object_deletion_burst",
    "plaintext_key_files",
    "short_lifecycle",
    "staged_encrypt",
    "webdav_retrieval_hosts",
    "webdav_script_execution",
]
