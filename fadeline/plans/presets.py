"""Preset configurations of the three fusion models: changes against the base configuration."""

from __future__ import annotations

from .experiments import BASE_CONFIG

# For each model its configurations in catalogue order, by name, with what differs from the base.
CATALOGUE = {
    "cpmlp_cpgru_fusion": {
        "base": {},
        "drop005": {"dropout": 0.05},
        "drop020": {"dropout": 0.2},
        "drop030": {"dropout": 0.3},
        "lr5e4": {"lr": 5e-4},
        "lr3e4": {"lr": 3e-4},
        "wd1e4": {"weight_decay": 1e-4},
        "mlp96": {"mlp_embed_dim": 96},
        "mlp128": {"mlp_embed_dim": 128, "model_hidden": 384},
        "gru96": {"gru_embed_dim": 96, "gru_hidden": 96},
        "gru128": {"gru_embed_dim": 128, "model_hidden": 384, "gru_hidden": 128},
        "hidden384": {"model_hidden": 384},
        "wide_balanced": {"mlp_embed_dim": 96, "gru_embed_dim": 96, "model_hidden": 384, "gru_hidden": 96},
        "wide_lowdrop": {"mlp_embed_dim": 96, "gru_embed_dim": 96, "model_hidden": 384, "gru_hidden": 96, "dropout": 0.05, "lr": 5e-4},
        "compact_regularized": {"model_hidden": 192, "dropout": 0.2, "weight_decay": 1e-4},
        "compact_low_lr": {"gru_embed_dim": 48, "model_hidden": 192, "gru_hidden": 48, "dropout": 0.15, "lr": 5e-4},
        "wide_regularized": {"mlp_embed_dim": 96, "gru_embed_dim": 96, "model_hidden": 384, "gru_hidden": 96, "dropout": 0.2, "lr": 5e-4, "weight_decay": 1e-4},
        "clip05": {"clip_grad_norm": 0.5},
        "clip20": {"clip_grad_norm": 2.0},
        "huber005": {"huber_delta": 0.005},
        "huber010": {"huber_delta": 0.01},
        "huber050": {"huber_delta": 0.05},
        "plateau_lr": {"lr_scheduler_patience": 3},
        "plateau_low_lr": {"lr": 5e-4, "lr_scheduler_patience": 3},
        "zero_init": {"zero_output_init": True},
        "zero_init_lr5e4": {"lr": 5e-4, "zero_output_init": True},
        "zero_init_regularized": {"dropout": 0.15, "lr": 5e-4, "weight_decay": 1e-4, "zero_output_init": True},
        "zero_init_scale10": {"lr": 5e-4, "huber_delta": 0.1, "zero_output_init": True, "target_scale": 10.0},
        "zero_init_scale20": {"lr": 3e-4, "huber_delta": 0.2, "zero_output_init": True, "target_scale": 20.0},
    },
    "cpmlp_dsconv_fusion": {
        "base": {},
        "drop005": {"dropout": 0.05},
        "drop020": {"dropout": 0.2},
        "drop030": {"dropout": 0.3},
        "lr5e4": {"lr": 5e-4},
        "lr3e4": {"lr": 3e-4},
        "wd1e4": {"weight_decay": 1e-4},
        "mlp96": {"mlp_embed_dim": 96},
        "mlp128": {"mlp_embed_dim": 128, "model_hidden": 384},
        "gru48": {"gru_hidden": 48},
        "gru96": {"gru_hidden": 96},
        "dsconv96": {"dsconv_channels": 96},
        "dsconv32": {"dsconv_channels": 32},
        "dsconv128": {"dsconv_channels": 128, "dropout": 0.15, "lr": 5e-4},
        "hidden384": {"model_hidden": 384},
        "wide_balanced": {"mlp_embed_dim": 96, "model_hidden": 384, "gru_hidden": 96, "dsconv_channels": 96},
        "wide_lowdrop": {"mlp_embed_dim": 96, "model_hidden": 384, "gru_hidden": 96, "dsconv_channels": 96, "dropout": 0.05, "lr": 5e-4},
        "regularized_slow": {"dropout": 0.2, "lr": 5e-4, "weight_decay": 1e-4},
        "stable_small_branch": {"model_hidden": 192, "gru_hidden": 48, "dsconv_channels": 32, "dropout": 0.2, "lr": 5e-4, "weight_decay": 1e-4},
        "stable_low_lr": {"model_hidden": 192, "gru_hidden": 48, "dsconv_channels": 48, "dropout": 0.2, "lr": 3e-4, "weight_decay": 1e-4, "clip_grad_norm": 0.5},
        "mlp_strong_small_dsconv": {"mlp_embed_dim": 96, "model_hidden": 384, "gru_hidden": 48, "dsconv_channels": 48, "dropout": 0.15, "lr": 5e-4, "weight_decay": 1e-4},
        "clip05": {"clip_grad_norm": 0.5},
        "clip20": {"clip_grad_norm": 2.0},
        "huber005": {"huber_delta": 0.005},
        "huber010": {"huber_delta": 0.01},
        "huber050": {"huber_delta": 0.05},
        "plateau_lr": {"lr_scheduler_patience": 3},
        "plateau_low_lr": {"lr": 5e-4, "lr_scheduler_patience": 3},
        "zero_init": {"zero_output_init": True},
        "zero_init_lr5e4": {"lr": 5e-4, "zero_output_init": True},
        "zero_init_stable": {"model_hidden": 192, "gru_hidden": 48, "dsconv_channels": 48, "dropout": 0.2, "lr": 5e-4, "weight_decay": 1e-4, "clip_grad_norm": 0.5, "zero_output_init": True},
        "zero_init_scale10": {"lr": 5e-4, "huber_delta": 0.1, "zero_output_init": True, "target_scale": 10.0},
        "zero_init_scale20": {"lr": 3e-4, "huber_delta": 0.2, "zero_output_init": True, "target_scale": 20.0},
    },
    "cpmlp_cpdsconv_fusion": {
        "base": {},
        "drop005": {"dropout": 0.05},
        "drop015": {"dropout": 0.15},
        "drop020": {"dropout": 0.2},
        "lr5e4": {"lr": 5e-4},
        "lr3e4": {"lr": 3e-4},
        "lr7e4": {"lr": 7e-4},
        "wd1e4": {"weight_decay": 1e-4},
        "wd3e4": {"weight_decay": 3e-4},
        "mlp96": {"mlp_embed_dim": 96},
        "mlp128_hidden384": {"mlp_embed_dim": 128, "model_hidden": 384},
        "hidden384": {"model_hidden": 384},
        "hidden512": {"model_hidden": 512, "dropout": 0.15, "lr": 5e-4},
        "dsconv32": {"dsconv_channels": 32},
        "dsconv48": {"dsconv_channels": 48},
        "dsconv96": {"dsconv_channels": 96},
        "dsconv128": {"dsconv_channels": 128, "dropout": 0.15, "lr": 5e-4},
        "wide_balanced": {"mlp_embed_dim": 96, "model_hidden": 384, "dsconv_channels": 96, "lr": 5e-4},
        "wide_lowdrop": {"mlp_embed_dim": 96, "model_hidden": 384, "dsconv_channels": 96, "dropout": 0.05, "lr": 5e-4},
        "wide_regularized": {"mlp_embed_dim": 96, "model_hidden": 384, "dsconv_channels": 96, "dropout": 0.2, "lr": 5e-4, "weight_decay": 1e-4},
        "mlp_strong_dsconv48": {"mlp_embed_dim": 128, "model_hidden": 384, "dsconv_channels": 48, "dropout": 0.15, "lr": 5e-4, "weight_decay": 1e-4},
        "dsconv_strong_mlp64": {"dsconv_channels": 128, "dropout": 0.15, "lr": 5e-4},
        "compact_regularized": {"model_hidden": 192, "dsconv_channels": 48, "dropout": 0.2, "lr": 5e-4, "weight_decay": 1e-4},
        "compact_low_lr": {"model_hidden": 192, "dsconv_channels": 48, "dropout": 0.15, "lr": 3e-4, "weight_decay": 1e-4},
        "clip05": {"clip_grad_norm": 0.5},
        "clip20": {"clip_grad_norm": 2.0},
        "huber005": {"huber_delta": 0.005},
        "huber010": {"huber_delta": 0.01},
        "huber050": {"huber_delta": 0.05},
        "plateau_lr": {"lr_scheduler_patience": 3},
        "plateau_low_lr": {"lr": 5e-4, "lr_scheduler_patience": 3},
        "zero_init": {"zero_output_init": True},
        "zero_init_lr5e4": {"lr": 5e-4, "zero_output_init": True},
        "zero_init_stable": {"mlp_embed_dim": 96, "model_hidden": 384, "dsconv_channels": 96, "dropout": 0.15, "lr": 5e-4, "weight_decay": 1e-4, "zero_output_init": True},
        "zero_init_scale10": {"lr": 5e-4, "huber_delta": 0.1, "zero_output_init": True, "target_scale": 10.0},
        "zero_init_scale20": {"lr": 3e-4, "huber_delta": 0.2, "zero_output_init": True, "target_scale": 20.0},
    },
}
# Names of the quick selection, in catalogue order.
QUICK = {
    "cpmlp_cpgru_fusion": ("base", "lr5e4", "wide_lowdrop", "compact_low_lr", "huber005", "zero_init_lr5e4", "zero_init_scale10"),
    "cpmlp_dsconv_fusion": ("base", "lr5e4", "dsconv32", "stable_small_branch", "mlp_strong_small_dsconv", "zero_init_lr5e4", "zero_init_scale10"),
    "cpmlp_cpdsconv_fusion": ("base", "drop015", "lr5e4", "dsconv96", "wide_lowdrop", "mlp_strong_dsconv48", "compact_low_lr", "zero_init_lr5e4", "zero_init_scale10"),
}


def presets(model: str, size: str = "focused") -> list[dict]:
    """Named configurations of a model, in catalogue order: one for `smoke`, a few for `quick`, else all."""
    names = ("base",) if size == "smoke" else QUICK[model] if size == "quick" else CATALOGUE[model]
    return [{"name": n, **BASE_CONFIG, **CATALOGUE[model][n]} for n in names]
